"""Near copies of the pipeline are verified by their five-word shingles."""

import random

import corpus_pipeline
from cuelake.llm import shingles
from cuelake.llm.common import staged
from cuelake.llm.simhash_dedup import text_print

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, src string"


def jaccard(a, b):
    words = ["".join(c.lower() if c.isascii() else c for c in (t or "")).translate({ord(c): " " for c in "!,.?\n"}).split() for t in (a, b)]
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_pairs_against_a_plain_loop(spark):
    rng = random.Random(2)
    texts = [None, "", "!", "one", "One!", "a b c d e", "a b c d f"]
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    for k in range(40):
        texts.append(" ".join(rng.choice([w] * 180 + [f"v{k}"]) for w in base) + rng.choice(["", ".", "!"]))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "__row bigint, text string")
    pairs = [(0, 1), (0, 2), (1, 2), (3, 4), (5, 6)] + [(a, b) for b in range(7, len(texts)) for a in (7, 8, 9) if a < b]
    got = shingles.alike(docs, staged(spark.createDataFrame(pairs, "a bigint, b bigint")))
    want = [(a, b) for a, b in pairs if jaccard(texts[a], texts[b]) >= 0.8]
    assert sorted(map(tuple, got.collect())) == sorted(want) and 5 < len(want) < len(pairs)


def test_near_copies_and_wrong_links(spark):
    """Copies of one text go though they differ from each other; texts whose SimHashes are near by chance stay."""
    rng = random.Random(5)
    words = [f"word{rng.randrange(900)}" for _ in range(300)]
    rows = []
    for k in range(40):  # each alike to the base by 0.8 or more, to each other by less
        text = list(words)
        for at in rng.sample(range(300), 5):
            text[at] = f"other{rng.randrange(900)}"
        rows.append((k if k else 500, " ".join(text), "en", "s", 9, "x"))
    rows += [(100 + k, " ".join(words), "en", "s", 9, "x") for k in range(30)] + [(None, " ".join(words), "en", "s", 9, "x")] * 3
    # Nearly the same words in other orders: near SimHashes of words, hardly a shingle in common.
    rows += [(1_000 + k, " ".join([*rng.sample(words, 297), *(f"alien{k}{j}" for j in range(5))]), "en", "s", 9, "x") for k in range(10)]
    left = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, DOCS), None).collect()
    assert sorted(r.doc_id for r in left) == [1, *range(1_000, 1_010)]


def test_groups_against_all_pairs(spark):
    """Texts of the same words in several orders have one SimHash; those alike to each other, but not to the first, are linked too."""
    rng, near = random.Random(9), corpus_pipeline.NEAR_COPY
    texts = [None, "", "!", "?!", "one", "One!", "one two"]
    for _ in range(6):
        words = [f"word{rng.randrange(60)}" for _ in range(40)]
        for _ in range(3):
            rng.shuffle(words)
            for k in range(5):
                text = list(words)
                for at in rng.sample(range(40), k):
                    text[at] = rng.choice([text[at - 1], f"other{rng.randrange(9)}"])
                texts.append(" ".join(text) + rng.choice(["", "!"]))
    prints = [text_print((t or "").encode(), near["shingle"], near["least"]) for t in texts]
    root = list(range(len(texts)))
    links = [(a, b) for b in root for a in range(b) if (prints[a] ^ prints[b]).bit_count() <= near["radius"] and jaccard(texts[a], texts[b]) >= shingles.LINKED]
    for _ in texts:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    docs = spark.createDataFrame([*enumerate(texts), (4, "one")], "__row bigint, text string")
    got = shingles.verified_groups(docs, **near).collect()
    assert sorted(map(tuple, got)) == [(i, r) for i, r in enumerate(root) if i != r]
    heads = {}
    for i, p in enumerate(prints):
        heads.setdefault(p, i)
    assert any(root[a] != root[heads[prints[a]]] for a, _ in links)  # such links were lost


def test_pipeline_of_odd_and_empty_tables(spark, tmp_path):
    good = "the cat of the house and the dog in a garden is for that on as with be by at this " * 3
    rows = [
        (1, None, None, None, None, "x"), (2, "", "en", "a", 0, None), (3, " \n\t ", "zz", "a", 4, "x"), (4, good, "en", "b", 9, "x"), (4, good, "en", "b", 9, "x"),
        (None, good + "extra", "en", None, 9, "x"), (5, "word " * 30_000, "en", "b", 9, "x"), (6, "é ß MIT License. ☃", "de", "c", 9, "x"),
    ]
    items = spark.createDataFrame([(1, "one two three four five six seven. eight nine ten eleven twelve"), (2, None), (3, "")], "item_id bigint, text string")
    for name, table in (("odd", spark.createDataFrame(rows, DOCS)), ("none", spark.createDataFrame([], DOCS))):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        items.write.parquet(str(tmp_path / name / "benchmark.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert {r.doc_id for r in out} <= {4, None, 5, 6} and (out == [] if name == "none" else True)
