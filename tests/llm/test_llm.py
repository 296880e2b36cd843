"""The training-data operators against brute force, SQL and planted cases."""

import itertools
import re
import string
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from cuelake.llm import (
    bktree, chat_format, decontaminate, hmm_lm, language_id, license_scan, line_dedup, mixing, quality_fm, quality_rules, registry, simhash_dedup,
)
from cuelake.llm.common import crc_mod, in_parts, table
from cuelake.llm.components import connected
from tests import oracle

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, weight string, kept string"


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").toPandas()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and blank texts, repeated rows, a long text, clashing extra columns."""
    good = "the cat of the house and the dog in a garden is for that on as with be by at this " * 3
    rows = [
        (1, None, None, None, None, 1.0, "x", "y"), (2, "", "en", "a", 0, None, None, None), (3, " \n\t ", "zz", "a", 4, 1.0, "x", "y"),
        (4, good, "en", "b", 9, 1.0, "x", "y"), (4, good, "en", "b", 9, 1.0, "x", "y"), (None, good + "extra", "en", None, 9, 1.0, "x", "y"),
        (5, "word " * 30_000, "en", "b", 9, 1.0, "x", "y"), (6, "é ß MIT License. ☃", "de", "c", 9, 1.0, "x", "y"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("name", registry.ORACLE_SQL)
def test_sql(spark, sf_dir, name):
    oracle.check(spark, oracle.connection(sf_dir), sf_dir, registry.QUERIES[name], registry.ORACLE_SQL[name])


def frames_of(spark, df):
    """Every operator over a frame of documents."""
    items = spark.createDataFrame([(1, "one two three four five six seven. eight nine ten eleven twelve"), (2, None), (3, "")], "item_id bigint, text string")
    split = df.withColumn("held_out", F.lit(False))
    return {
        "license": license_scan.license_scan(df), "decontaminate": decontaminate.contaminated(df, items),
        "fm": quality_fm.classify(df, quality_fm.learn(df.withColumn("label", (F.col("doc_id") % 2).cast("int")))),
        "mixing": mixing.training_order(mixing.curriculum(df)), "rules": quality_rules.quality_rules(df),
        "lines": line_dedup.line_dedup(df), "simhash": simhash_dedup.near_groups(df),
        "language": language_id.identify(df, language_id.dictionaries(df)), "lm": hmm_lm.score_texts(split.select("doc_id", "held_out", "text")),
    }


def test_odd_rows(spark, odd):
    got = {name: f.collect() for name, f in frames_of(spark, odd).items()}
    n = odd.count()
    for name in ("license", "fm", "rules", "lines", "simhash", "language", "lm"):
        assert len(got[name]) == n, name
    assert got["decontaminate"] == []
    by_id = {r.doc_id: r for r in got["license"]}
    assert by_id[6].base_labels == "mit" and by_id[1].n_words == 0 and by_id[1].score == 0
    assert {r.lang_pred for r in got["language"] if r.doc_id in (1, 2, 3)} == {"und"}
    assert {r.fingerprint for r in got["simhash"] if r.doc_id in (1, 2, 3)} == {"0" * 16}
    assert all(r.component_id == 1 for r in got["simhash"] if r.doc_id in (1, 2, 3))
    assert all(r.n_tokens == 1 for r in got["lm"] if r.doc_id in (1, 2, 3))
    assert not any(r.kept for r in got["rules"] if r.doc_id in (1, 2, 3, 5))
    texts = Counter(r.text for r in got["lines"])
    assert texts[None] == 1


def test_empty_table(spark, odd):
    for name, f in frames_of(spark, odd.limit(0)).items():
        assert f.count() == 0, name


def test_license_scan(spark, sf_dir, docs):
    got = {r.doc_id: r for r in license_scan.op1_license_scan(spark, sf_dir).collect()}
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    for i, text in zip(docs.doc_id, docs.text):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(lower))
        at = [(k, label) for p, label in license_scan.BASE_PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels


def test_license_template_without_its_name(spark):
    text = "x " * 50 + license_scan.TEMPLATES[1][1] + " y" * 50
    r = license_scan.license_scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert (r.base_labels, r.labels, r.found[0].start) == ("", "mit", 50)


def test_license_several_in_one_file(spark):
    vocabulary = license_scan._vocabulary(license_scan.TEMPLATES, ())
    assert max(len(set(t.split()) & set(vocabulary)) for _, t, _ in license_scan.TEMPLATES) <= license_scan.RARE
    numbers = range(len(license_scan.TEMPLATES))
    sets = [c for k in (1, 2, 3, 4, len(numbers)) for c in itertools.combinations(numbers, k)]
    texts = [(i, "x " * 40 + " y z ".join(license_scan.TEMPLATES[t][1] for t in c) + " y" * 40) for i, c in enumerate(sets)]
    got = license_scan.license_scan(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    for r in got:
        want = sets[r.doc_id]
        assert r.labels == ",".join(sorted({license_scan.TEMPLATES[t][0] for t in want}))
        assert {f.template for f in r.found if f.share == 1} >= set(want)


def test_license_long_file(spark):
    """Cost in proportion to the licence words of one row; labels, score and places as computed apart."""
    text = "license software " * 50_000 + license_scan.TEMPLATES[6][1]
    r = license_scan.license_scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert (r.n_words, r.labels, r.score) == (100_000 + len(license_scan.TEMPLATES[6][1].split()), "bsd", 1.0)
    draw, rows = np.random.default_rng(6), []
    for i in range(120):
        words = []
        for t in draw.choice(len(license_scan.TEMPLATES), int(draw.integers(0, 4))):
            own = license_scan.TEMPLATES[t][1].split()
            for k in draw.choice(len(own), int(draw.integers(0, 5)), replace=False):
                own[k] = "changed"
            words += ["z"] * int(draw.integers(0, 9)) + own
        rows.append((i, " ".join(words + ["z"])))
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id bigint, text string"), rare=99).collect()}
    vocabulary = set(license_scan._vocabulary(license_scan.TEMPLATES, license_scan.BASE_PHRASES))
    for i, text in rows:
        w, found, bases = text.split(), set(), {label for p, label in license_scan.BASE_PHRASES if f" {p} " in f" {text} "}
        for t, (label, template, keys) in enumerate(license_scan.TEMPLATES):
            own = template.split()
            for start in range(-len(own), len(w)):
                hits = [x for k, x in enumerate(own) if 0 <= start + k < len(w) and w[start + k] == x]
                begin = max(0, start - license_scan.NEAR)
                near = f" {' '.join(w[begin : begin + len(own) + 2 * license_scan.NEAR])} "
                if len(set(hits) & vocabulary) > 1 and len(hits) / len(own) >= license_scan.LEAST_SHARE and all(f" {k} " in near for k in keys):
                    found.add((t, start, len(hits) / len(own)))
        assert {(f.template, f.start, f.share) for f in got[i].found} == found
        assert got[i].labels == ",".join(sorted(bases | {license_scan.TEMPLATES[t][0] for t, _, _ in found}))
        assert got[i].score == (1.0 if bases else max((s for *_, s in found), default=0.0))


def test_decontaminate(spark, sf_dir, docs):
    got = {(r.doc_id, r.item_id) for r in decontaminate.op2_decontaminate(spark, sf_dir).collect()}
    items = table(spark, sf_dir, "benchmark").toPandas()
    whole = [(i, decontaminate.shingles(decontaminate.tokens(t.encode()))) for i, t in zip(items.item_id, items.text)]
    want = set()
    for d, t in zip(docs.doc_id, docs.text):
        have = decontaminate.shingles(decontaminate.tokens((t or "").encode()))
        want |= {(d, i) for i, own in whole if len(own & have) / len(own) >= 0.95}
    assert want and want <= got and len(got - want) <= 1


def test_decontaminate_by_whole_items(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").toPandas()
    draw, rows, want = np.random.default_rng(2), [], set()
    for i, text in zip(items.item_id, items.text):
        words = decontaminate.tokens(text.encode())
        whole = decontaminate.shingles(words)
        for k in [*draw.integers(0, len(words), 5).tolist(), len(words) - 1]:
            copy = [b"lorem"] * 30 + words[:k] + [b"changed"] + words[k + 1 :] + [b"ipsum"] * 30
            if len(words) >= 5 and len(whole & decontaminate.shingles(copy)) / len(whole) >= 0.8:
                want.add((len(rows), i))
            rows.append((len(rows), b" ".join(copy).decode()))
    found = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), table(spark, sf_dir, "benchmark"))
    assert want and want <= {(r.doc_id, r.item_id) for r in found.collect()}


def test_decontaminate_against_all_items(spark, sf_dir, docs):
    """Every passage against every item by the same scores and overlaps, in one shard and in many."""
    items = table(spark, sf_dir, "benchmark").toPandas()
    pairs = [(i, *decontaminate.question_and_answer(t)) for i, t in zip(items.item_id, items.text)]
    index = decontaminate.Index(pairs, whole=True)
    terms = {i: set(decontaminate.tokens(t.encode())) for i, t in zip(items.item_id, items.text)}
    impact = {(n, t): w for t in range(len(index.terms)) for n, w in zip(index.postings[t].tolist(), index.impacts[t].tolist())}
    names = list(index.terms)
    by_item = [{x: impact[n, index.terms[x]] for x in terms[i]} for n, i in enumerate(index.ids)]
    assert set(names) == set().union(*terms.values())
    assert {decontaminate.length_class(len(decontaminate.tokens(t.encode()))) for t in items.text} == {decontaminate.LEAST_HALF}
    want = set()
    for d, text in zip(docs.doc_id, docs.text):
        words = decontaminate.tokens((text or "").encode())
        step = decontaminate.length_class(index.longest)
        for start in range(0, max(1, len(words) - step), step):
            part = words[start : start + 2 * step]
            have, runs = set(part), decontaminate.shingles(part)
            for n, i in enumerate(index.ids):
                if sum(w for x, w in by_item[n].items() if x in have) < decontaminate.THRESHOLD:
                    continue

                def share(own, part=part, runs=runs):
                    if len(own) >= 5:
                        return len(decontaminate.shingles(own) & runs) / len(decontaminate.shingles(own))
                    return float(any(part[k : k + len(own)] == own for k in range(len(part))))

                parts = [decontaminate.tokens(x.encode()) for x in pairs[n][1:]]
                if min(share(x) for x in parts if x) >= 0.8 or share(parts[0] + parts[1]) >= 0.8:
                    want.add((d, i))
    for shard_words in (decontaminate.SHARD_WORDS, 300):
        got = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), shard_words=shard_words)
        assert want and {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_wand_finds_all_above_threshold():
    draw = np.random.default_rng(1)
    words = [f"w{i}" for i in range(60)]
    index = decontaminate.Index([(k, " ".join(draw.choice(words, 12)), " ".join(draw.choice(words, 4))) for k in range(300)])
    for _ in range(60):
        terms = sorted({index.terms[w] for w in (x.encode() for x in draw.choice(words, 25)) if w in index.terms})
        scores = np.zeros(300)
        for t in terms:
            np.add.at(scores, index.postings[t], index.impacts[t])
        for threshold in (0.3, 0.6):
            assert {i for i, _ in index.search(terms, threshold)} == set(np.flatnonzero(scores >= threshold - 1e-9))


def test_quality_fm(spark, sf_dir):
    r = quality_fm.op3_quality_fm(spark, sf_dir.replace("sf0.001", "sf0.01")).toPandas()
    labels = table(spark, sf_dir.replace("sf0.001", "sf0.01"), "labels").toPandas()
    held = r[r.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.95
    assert ((r.score >= 0.5).astype(int) == r.predicted).all()


def test_pairs_in_linear_time():
    draw = np.random.default_rng(0)
    m = quality_fm.Machine(0.1, draw.normal(size=quality_fm.INPUTS), draw.normal(0, 0.1, (quality_fm.INPUTS, 3)))
    places, values = np.array([1, 5, 9, 4100]), np.array([0.5, 0.2, 0.1, 1.0])
    z = m.bias + values @ m.weights[places]
    z += sum(values[i] * values[j] * (m.factors[places[i]] @ m.factors[places[j]]) for i in range(4) for j in range(i))
    other = (np.array([7, 4101]), np.array([1.0, 1.0]))
    assert abs(m.score([(places, values), other])[0] - 1 / (1 + np.exp(-z))) < 1e-12


def test_mixing_meets_targets(spark, sf_dir):
    df = mixing.op4_mixing(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").toPandas()
    assert (df.taken <= 3 * df["size"]).all()
    by = df.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((by.taken - by.target).abs() <= 1).all()
    assert abs(by.target.sum() - df["size"].sum()) < 1e-3
    order = mixing.training_order(mixing.curriculum(table(spark, sf_dir, "documents"))).select("position").toPandas().position
    assert order.between(0, 1).all()


def test_quality_rules(spark, sf_dir, docs):
    got = {r.doc_id: r for r in quality_rules.op5_quality_rules(spark, sf_dir).collect()}
    for i, text in zip(docs.doc_id, docs.text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n = len(w) - 7
        often = Counter(tuple(w[k : k + 8]) for k in range(n))
        hit = {k + j for k in range(n) if often[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines, seen, dup = (text or "").split("\n"), set(), 0
        for x in lines:
            if re.search(r"[^\x20\x09-\x0D]", x):
                dup += x in seen
                seen.add(x)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 20 or 100 * len(hit) > 30 * len(w)) and not (r.base_failed and r.kept)
    labels = table(spark, sf_dir, "labels").toPandas()
    kept = labels.assign(kept=[got[i].kept for i in labels.doc_id], base=[got[i].base_failed for i in labels.doc_id])
    assert kept[(kept.quality == 1) & ~kept.base].kept.mean() > 0.98
    assert kept[kept.quality == 0].kept.mean() < 0.1


def test_quality_rules_distances(spark):
    """Distances and verdict of a small table, with references computed anew for each document."""
    draw = np.random.default_rng(4)
    words = {"en": quality_rules.COMMON_WORDS["en"], "de": quality_rules.COMMON_WORDS["de"]}
    rows = []
    for i in range(40):
        lang = [None, "en", "de", "xx"][int(draw.integers(0, 4))] if i < 38 else "solo"
        own = [*words["de" if lang == "de" else "en"], *(f"w{k}" for k in range(30))]
        rows.append((i, lang, " ".join(draw.choice(own, int(draw.integers(10, 90)))) + ("!#$" * 60 if i % 9 == 0 else "")))
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id bigint, lang string, text string")).collect()}
    classes = {i: quality_rules._text_counts(t.encode())[0] for i, _, t in rows}

    def alike(counts):
        return {k: v * 1_000_000 // sum(counts.values()) for k, v in counts.items()} if sum(counts.values()) else {}

    def distance(own, others):
        if len(others) < 5:
            return None
        total = Counter()
        for o in others:
            total.update(alike(o))
        n, m, out = sum(own.values()), sum(total.values()), 0.0
        for k in set(own) | set(total):
            p, q = own.get(k, 0) / n, total.get(k, 0) / m
            out += sum(x * np.log2(2 * x / (p + q)) for x in (p, q) if x)
        return max(0.0, out / 2) ** 0.5

    def bins(text, own):
        listed = {f: w for w in quality_rules.COMMON_WORDS[own] for f in (w, w.capitalize())}
        return Counter(listed.get(w, "") for w in text.split())

    for i, lang, text in rows:
        char = {k: Counter(dict(enumerate(map(int, c)))) for k, c in classes.items()}
        same = [char[k] for k, other, _ in rows if k != i and other == lang and lang is not None]
        want = distance(char[i], same)
        want = distance(char[i], [char[k] for k, _, _ in rows if k != i]) if want is None else want
        want = 0.0 if len(text) < quality_rules.MIN_CHARS else want
        assert abs(got[i].char_distance - want) < 1e-6
        lists = [lang] if lang in ("en", "de") else ["en", "de"]
        by_word = [distance(bins(text, x), [bins(t, x) for k, other, t in rows if k != i and other == x]) for x in lists]
        by_word = 0.0 if len(text.split()) < quality_rules.MIN_HISTOGRAM_WORDS else min(by_word)
        assert abs(got[i].word_distance - by_word) < 1e-6
        far = got[i].char_distance > 0.22 + 0.6 / len(text) ** 0.5 or got[i].word_distance > 0.19 + 0.9 / len(text.split()) ** 0.5
        assert got[i].kept == (not got[i].base_failed and not far)


def test_quality_rules_without_language(spark, sf_dir):
    base = table(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents").select("doc_id", "lang", "text")
    labels = table(spark, sf_dir.replace("sf0.001", "sf0.01"), "labels")
    known = {r.doc_id: r for r in quality_rules.quality_rules(base).collect()}
    quality = {r.doc_id: r.quality for r in labels.collect()}
    listed = base.crossJoin(spark.createDataFrame([(0,), (1,)], "copy int"))
    for other in (None, "xx"):
        # a copy of each labelled text with its language, one without
        mixed = listed.select((F.col("doc_id") * 2 + F.col("copy")).alias("doc_id"), F.when(F.col("copy") == 0, F.col("lang")).otherwise(F.lit(other)).alias("lang"), "text")
        got = {r.doc_id // 2: r.kept for r in quality_rules.quality_rules(mixed).collect() if r.doc_id % 2}
        junk = [i for i, q in quality.items() if q == 0 and not known[i].base_failed]
        good = [i for i, q in quality.items() if q == 1 and not known[i].base_failed]
        assert sum(got[i] for i in junk) <= sum(known[i].kept for i in junk) + 1
        assert sum(got[i] for i in good) >= 0.98 * len(good)


def test_chat_events(spark):
    events = [
        (1, 0, "message", 0, "user", "hi </s>"), (1, 1, "message", 1, "assistant", ""), (1, 2, "delta", 1, None, "one "), (1, 3, "delta", 1, None, "two"),
        (1, 4, "message", 2, "user", "gone"), (1, 5, "regenerate", 1, "assistant", None), (1, 6, "delta", 1, None, "three\\"), (1, 7, "message", 2, "user", "next"),
        (1, 8, "edit", 2, None, "edited"), (2, 0, "message", 0, None, None),
    ]
    df = spark.createDataFrame(events, "conv_id bigint, seq bigint, kind string, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat_format.format_chats(df).collect()}
    assert chat_format.read_back(got[1].formatted) == [("user", "hi </s>"), ("assistant", "three\\"), ("user", "edited")]
    a, b = got[1].loss_spans[0]
    assert chat_format.unescape(got[1].formatted[a:b]) == "three\\"
    assert chat_format.read_back(got[2].formatted) == [("", "")]
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_chat_log_of_finished_turns(spark, sf_dir):
    """The query's log holds deltas, edits and regenerations, and its fold gives the table back."""
    given = table(spark, sf_dir, "conversations").unionByName(
        spark.createDataFrame([(-1, None, "user", None), (-1, None, "user", None), (-1, 2**63 - 1, "assistant", "é"), (-1, 3, None, ""), (None, 1, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    )
    log = chat_format.events_of(given)
    kinds = {r.kind: r["count"] for r in log.groupBy("kind").count().collect()}
    assert min(kinds.get(k, 0) for k in ("message", "delta", "edit", "regenerate")) > 10 and kinds["message"] > given.count()
    want = {}
    for r in sorted(given.collect(), key=lambda r: (r.turn is not None, r.turn or 0, r.role or "", r.text or "")):
        want.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    assert {r.conv_id: chat_format.read_back(r.formatted) for r in chat_format.format_chats(log).collect()} == want


def groups_of(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("shard", [2, 4096])
def test_simhash_groups(spark, sf_dir, docs, shard):
    got = {r.doc_id: r for r in simhash_dedup.near_groups(table(spark, sf_dir, "documents"), shard=shard).collect()}
    ids, prints = sorted(docs.doc_id), {}
    for i, t in zip(docs.doc_id, docs.text):
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert got[i].fingerprint == f"{prints[i]:016x}"
    near = [(a, b) for a in range(len(ids)) for b in range(a) if (prints[ids[a]] ^ prints[ids[b]]).bit_count() <= 4]
    assert [got[i].component_id for i in ids] == [ids[r] for r in groups_of(len(ids), near)]


def test_bk_trees():
    draw = np.random.default_rng(3)
    prints = np.unique(draw.integers(0, 2**64, 40, dtype=np.uint64)[draw.integers(0, 40, 300)] ^ (np.uint64(1) << draw.integers(0, 64, 300, dtype=np.uint64)))
    tree = np.sort(draw.integers(0, 5, len(prints)))
    got = {(q, i) for who, item in bktree.Forest(prints, tree).within(prints, tree, 4) for q, i in zip(who.tolist(), item.tolist())}
    want = {(a, b) for a in range(len(prints)) for b in range(len(prints)) if tree[a] == tree[b] and int(prints[a] ^ prints[b]).bit_count() <= 4}
    assert got == want


def test_components(spark):
    draw = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in draw.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(300, 400)] + [(500, k) for k in range(501, 600)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    want = groups_of(600, pairs)
    assert all(got.get(x, x) == want[x] for x in range(600))


def lines_of(texts, least=1):
    """Normalised lines by their first place, by another way than the operator's."""
    out = {}
    for text in texts:
        for line in (text or "").split("\n"):
            low = "".join(c.lower() if "A" <= c <= "Z" else c if ord(c) > 127 or c.isalpha() else "0" if c.isdigit() else " " for c in line)
            if len(plain := " ".join(w for w in low.split(" ") if w)) >= least:
                out.setdefault(plain, len(out))
    return list(out)


def similar_pairs(lines, similarity=0.8):
    """All pairs of lines by edit similarity alone; pairs whose letters differ too often are passed over (an edit changes two at most)."""
    bags = np.stack([np.bincount([ord(c) & 255 for c in x], minlength=256) for x in lines]).astype(np.int32)
    two = np.stack([np.bincount([(ord(c) * 37 + ord(d)) & 255 for c, d in zip(x, x[1:])], minlength=256) for x in lines]).astype(np.int32)
    size, out = np.array([len(x) for x in lines]), []
    for a in range(len(lines)):
        most = ((1 - similarity) * np.maximum(size[:a], size[a]) + 1e-9).astype(int)
        near = (np.abs(bags[:a] - bags[a]).sum(axis=1) <= 2 * most) & (np.abs(two[:a] - two[a]).sum(axis=1) <= 4 * most)
        out += [(a, int(b)) for b in np.flatnonzero(near) if line_dedup.edit_distance(lines[a], lines[b], int(most[b])) <= most[b]]
    return out


@pytest.mark.parametrize("shard, radius", [(2, 48), (4096, line_dedup.RADIUS)])
def test_line_dedup_against_all_pairs(spark, sf_dir, docs, shard, radius):
    """Groups against plain edit similarity over all pairs of lines of 20 code points or more: no wrong link, recall of 0.9 or more."""
    table_ = table(spark, sf_dir, "documents")
    got = {r.doc_id: r for r in line_dedup.line_dedup(table_, shard=shard, radius=radius).collect()}
    lines = lines_of([t for _, t in sorted(zip(docs.doc_id, docs.text))], line_dedup.MIN_CHARS)
    pairs = similar_pairs(lines)
    root = groups_of(len(lines), pairs)
    all_lines = lines_of([t for _, t in sorted(zip(docs.doc_id, docs.text))])
    left = Counter(x for i in sorted(got) for x in lines_of_row(got[i].text))
    assert max(left.values()) == 1  # no exact repeat stays
    place = {x: k for k, x in enumerate(lines)}
    gone = [x for x in all_lines if x not in left]
    assert all(x in place and root[place[x]] != place[x] for x in gone)
    should = [x for x in lines if root[place[x]] != place[x]]
    assert len(should) > 10 and sum(x not in left for x in should) >= 0.9 * len(should)
    assert all(len((r.text or "").split("\n")) == max(1, r.n_lines - r.n_removed) for r in got.values())


def lines_of_row(text):
    low = (text or "").encode()
    return [b" ".join(w).decode() for w in line_dedup.normal_lines(low) if w]


def test_rows_of_null_and_equal_ids(spark):
    """Rows of null or equal doc_id are documents of their own, in line dedup and in the pipeline's stages."""
    line = "the lamp of the old house by the river was lit again at "
    texts = [f"{line}{n}\nonly in {n} a boat came along the shore" for n in ("night", "noon")]
    rows = [(None, texts[0]), (None, "short\n" * 2 + "one row of its own that stands here alone\n" + texts[1]), (None, None), (7, "alone"), (7, texts[1]), (7, texts[1])]
    docs = spark.createDataFrame([(i, t, None, "a", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for radius in (line_dedup.RADIUS, 48):
        got = line_dedup.line_dedup(docs, radius=radius).collect()
        assert len(got) == len(rows) and sum(r.text is None for r in got) == 1
        left = Counter(x for r in got if r.text for x in r.text.split("\n"))
        assert left["one row of its own that stands here alone"] == left["only in night a boat came along the shore"] == left["alone"] == 1
    words = [" ".join(f"{w}{k}" for k in range(40)) for w in ("ab", "cd", "ef")]
    near = [(None, words[0]), (None, words[1]), (None, words[1]), (5, words[2]), (5, words[0] + " more"), (4, words[2])]
    docs = spark.createDataFrame([(i, t, None, "a", 1) for i, t in near], docs.schema)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "").select("doc_id", "text").collect()
    assert (4, words[2]) in kept and (None, words[1]) in kept and len({r.text[:2] for r in kept}) == 3


def test_line_dedup_removes_short_and_unspaced_repeats(spark):
    lines = ["ok", "", "你好世界今天天气很好我们一起去公园散步吧", "the end", "你好世界今天天气很好我们一起去公园散步啊", "不同的一行文字在这里没有重复出现过的内容"]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(["OK", "", "The end.", lines[2], "no"]))], "doc_id bigint, text string")
    got = {r.doc_id: r.text.split("\n") for r in line_dedup.line_dedup(docs).collect()}
    assert got == {1: lines[:4] + lines[5:], 2: ["", "no"]}


def one_pair(a, b):
    most = int(0.2 * max(len(a), len(b)) + 1e-9)
    return line_dedup.edit_distance(a, b, most) <= most


def test_line_dedup_by_edit_similarity_alone(spark):
    """Planted lines against plain edit similarity, with no SimHash in the brute force."""
    draw = np.random.default_rng(11)
    words = ["".join(draw.choice(list("abcdefghiklmnoprstu"), draw.integers(2, 10))) for _ in range(3000)]
    lines = ["ha " * 9 + "no", "ha " * 9 + "yes"]
    for n, changed in [(10, 1), (20, 1), (20, 2), (40, 2), (40, 4)] * 12:
        one = list(draw.choice(words, n))
        two = list(one)
        for k in draw.choice(n, changed, replace=False):
            two[k] = str(draw.choice(words))
        lines += [" ".join(one), " ".join(two)]
    links = [(a, b) for a in range(len(lines)) for b in range(a) if one_pair(lines[a], lines[b])]
    root = groups_of(len(lines), links)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    got = {r.doc_id: r.n_removed for r in line_dedup.line_dedup(docs).collect()}
    want = {k for k in range(len(lines)) if root[k] != k}
    assert len(want) > 50 and got[1] == 1
    assert {k for k in got if got[k]} <= want and sum(got[k] for k in want) >= 0.95 * len(want)


def test_edit_distance():
    draw = np.random.default_rng(5)
    for _ in range(500):
        a, b = ("".join(draw.choice(list("abc"), draw.integers(0, 12))) for _ in "12")
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[:], i
            for j, y in enumerate(b, 1):
                row[j] = min(row[j - 1] + 1, last[j] + 1, last[j - 1] + (x != y))
        most = int(draw.integers(0, 12))
        got = line_dedup.edit_distance(a, b, most)
        assert got == row[-1] if row[-1] <= most else got > most


def test_similar_pairs_together():
    """Edits counted for many pairs together against one pair at a time, over lengths of one word of bits and of many."""
    draw, a, b = np.random.default_rng(7), [], []
    for n in (5, 30, 64, 65, 130, 300, 900):
        for _ in range(100):
            one = draw.choice(list("abcd é "), n)
            two = one.copy()
            for k in draw.integers(0, n, draw.integers(0, max(2, n // 2))):
                two[k] = draw.choice(list("abcdé"))
            a.append(" ".join("".join(one).split()).encode())
            b.append(" ".join("".join(two[int(draw.integers(0, 3)) :]).split()).encode())
    most = [int(0.2 * max(len(x.decode()), len(y.decode())) + 1e-9) for x, y in zip(a, b)]
    want = [line_dedup.edit_distance(x.decode(), y.decode(), m) <= m for x, y, m in zip(a, b, most)]
    assert line_dedup.similar(a, b, 0.8).tolist() == want and 50 < sum(want) < 650


def test_bands_count_edits():
    """Edits in a band are those of the whole matrix, or are said to be too many, at any width of the band."""
    rng = np.random.default_rng(5)
    for width in (1, 2, 3):
        rows = []
        for size in (1, 5, 31, 32, 33, 63, 64, 65, 96, 127, 128, 129, 300) * 4:
            x = rng.integers(0, 4, size)
            y = [int(c) for c in x]
            for _ in range(rng.integers(0, 1 + size // 3)):
                y[(k := int(rng.integers(0, len(y) + 1))) : k + int(rng.integers(0, 2))] = rng.integers(0, 4, int(rng.integers(0, 2))).tolist()
            rows.append(sorted((x, np.array(y, np.int64)), key=len)[::-1])
        rows = sorted(((x, y) for x, y in rows if len(y) and len(x) - len(y) < 32 * width), key=lambda r: -len(r[1]))
        most = np.array([int(0.3 * len(x)) for x, _ in rows])
        got = line_dedup._banded([x for x, _ in rows], [y for _, y in rows], most, width)
        for (x, y), m, n in zip(rows, np.minimum(most, 32 * width - 1).tolist(), got.tolist()):
            edits = line_dedup.edit_distance(bytes(x.tolist()), bytes(y.tolist()), m)
            assert n == -1 or (n == edits if edits <= m else n > m)
        assert 10 < (got >= 0).sum() and 5 < ((got >= 0) & (got <= most)).sum()


def test_groups_of_lines_that_share_an_id(spark, monkeypatch):
    """Linked lines of one id and other keys are told apart by their keys, and ids give the same groups as keys."""
    same = "the committee met on monday to talk about the new harbour and its costs {}"
    other = "a flock of {} geese crossed the frozen lake before anybody had seen the sun"
    rows = [(i, line) for i, line in enumerate([same.format("today"), same.format("now"), other.format("wild"), other.format("grey")])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")

    def removed():
        return sorted(r.doc_id for r in line_dedup.line_dedup(docs).filter("n_removed = 1").collect())

    assert removed() == [1, 3]
    monkeypatch.setattr(line_dedup, "line_prints", lambda *a, plain=line_dedup.line_prints: plain(*a).withColumn("id", F.pmod("id", F.lit(3))))
    assert set(removed()) <= {1, 3}


def test_parts_of_batches():
    batch = pa.RecordBatch.from_arrays([pa.array(range(2500))], names=["n"])
    parts = list(in_parts(iter([batch, batch.slice(0, 0), batch.slice(0, 3)])))
    assert [p.num_rows for p in parts] == [1000, 1000, 500, 3] and parts[1].column(0)[0].as_py() == 1000


def test_marks_of_lines(monkeypatch):
    """Lines give the same marks alone and beside others; equal runs give equal cells."""
    draw = np.random.default_rng(8)
    words = ["".join(draw.choice(list("abcdefgéñ"), draw.integers(1, 12))) for _ in range(300)]
    lines = [" ".join(draw.choice(words, n)).encode() for n in (1, 2, 3, 8, 20, 40, 90, 400)] + ["你好世界今天天气很好我们一起去公园散步吧".encode()]
    prints, cells, count = line_dedup.marks_of(lines)
    parts = np.split(cells, np.cumsum(count)[:-1])
    for line, own, part in zip(lines, prints, parts):
        one, alone, n = line_dedup.marks_of([line])
        assert one[0] == own and alone.tolist() == part.tolist() and n[0] == len(part)
    changed = lines[7].split()
    changed[200] = b"changed"
    other = line_dedup.marks_of([b" ".join(changed)])
    assert set(other[1].tolist()) & set(parts[7].tolist()) and int(other[0][0] ^ prints[7]).bit_count() < 12


def test_language_id(spark, sf_dir):
    where = sf_dir.replace("sf0.001", "sf0.01")
    r = language_id.op9_language_id(spark, where).toPandas().merge(table(spark, where, "documents").toPandas(), on="doc_id")
    held = r[r.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.96
    sure = held[~held.rejected]
    assert (sure.lang_pred == sure.lang).mean() > 0.98


def test_language_letters(spark):
    assert language_id.letters("²½ Ⅷ 12 _") == "" and language_id.letters("Éa² b½ª") == "éa b ª"
    known = {"en": b"the cat of the house", "de": b"die katze und das haus"}
    rows = [(1, "½²"), (2, "the cat of the house and the cat"), (3, None)]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id bigint, text string"), known).collect()
    assert [r.lang_pred for r in sorted(got, key=lambda r: r.doc_id)] == ["und", "en", "und"]


def test_hmm_against_all_paths():
    from itertools import product

    draw = np.random.default_rng(0)
    m = hmm_lm.Model.start(3, 5)
    texts = [draw.integers(0, 5, n).astype(np.int16) for n in (1, 2, 4, 6, 5)]
    first, move, say, logs = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5)), []
    for o in texts:
        paths = {}
        for p in product(range(3), repeat=len(o)):
            w = m.first[p[0]] * m.say[p[0], o[0]]
            for k in range(1, len(o)):
                w *= m.move[p[k - 1], p[k]] * m.say[p[k], o[k]]
            paths[p] = w
        total = sum(paths.values())
        logs.append(np.log10(total))
        for p, w in paths.items():
            first[p[0]] += w / total
            for k in range(len(o)):
                say[p[k], o[k]] += w / total
                if k:
                    move[p[k - 1], p[k]] += w / total
    assert np.allclose(hmm_lm.log_likelihoods(m, texts), logs)
    for got, want in zip(hmm_lm.expected_counts(m, texts), (first, move, say)):
        assert np.allclose(got, want)


def test_hmm_lm(spark, sf_dir, docs):
    base = table(spark, sf_dir, "documents").select("doc_id", (crc_mod(F.col("doc_id"), 10) == 0).alias("held_out"), "text")
    got = hmm_lm.score_texts(base, head=300).toPandas().set_index("doc_id")
    counts, n_train = Counter(), 0
    for i, t in zip(docs.doc_id, docs.text):
        if zlib.crc32(str(i).encode()) % 10:
            counts.update((t or "").encode().lower().split())
            n_train += 1
    counts["end"] = n_train
    total, size = sum(counts.values()), sum(counts.values()) + 0.1 * (len(counts) + 1)
    for i, t in zip(docs.doc_id, docs.text):
        w = (t or "").encode().lower().split() + ["end"]
        r = got.loc[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), total)
        assert abs(r.base_score - sum(np.log10((counts[x] + 0.1) / size) for x in w)) < 1e-6 * len(w)
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_pipeline_near_copies(spark):
    """Copies whose five-word shingles are similar by 0.8 or more go, other texts stay."""
    draw = np.random.default_rng(12)
    words = ["".join(draw.choice(list("abcdefghiklmnoprstu"), draw.integers(2, 10))) for _ in range(4000)]
    rows, copies = [], 0
    for i in range(150):
        one = list(draw.choice(words, int(draw.integers(150, 500)))) + ["the", "of", "and", "to"] * 40
        draw.shuffle(one)
        rows.append((2 * i, " ".join(one)))
        if i % 2:
            for k in draw.choice(len(one), int(len(one) * draw.uniform(0.002, 0.022)), replace=False):
                one[k] = str(draw.choice(words))
            rows.append((2 * i + 1, " ".join(one)))
            copies += 1
    docs = spark.createDataFrame([(i, t, None, "a", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert {i for i, _ in rows if i % 2 == 0} <= kept
    assert sum(i not in kept for i, _ in rows if i % 2) >= 0.9 * copies


def test_pipeline(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(stage(spark, docs, sf_dir))
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
        assert 0 < docs.count() <= before, name
        before = docs.count()
    groups = simhash_dedup.near_groups(docs, **corpus_pipeline.NEAR_COPY)
    assert groups.select("component_id").distinct().count() == before, "near copies are left"
    assert decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).isEmpty()
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert mixed.agg(F.sum("words")).first()[0] > 0
    assert corpus_pipeline.run(spark, sf_dir).count() == mixed.count()


def test_identify_against_a_plain_loop(spark, docs):
    """Whole results of the language operator, text by text and dictionary by dictionary."""
    known = {"de": b"der die das und nicht ein haus", "en": b"the of and house is not a", "fr": b"le la les et une maison pas"}
    rows = docs.head(120)[["doc_id", "text"]]
    rows.loc[len(rows)] = [-1, "x\u00b2 \u2167 1a_b"]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows), known, piece=500).collect()}
    for doc_id, text in rows.itertuples(index=False):
        only = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        plain = " ".join(only).encode()
        if not plain:
            assert tuple(got[doc_id])[1:] == ("und", 0.0, 0.0, True)
            continue
        n = max(1, round(len(plain) / 500))
        sizes = []
        for lang, content in known.items():
            made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            tool = zstandard.ZstdCompressor(dict_data=made, level=language_id.LEVEL, write_content_size=False, write_checksum=False)
            sizes.append((sum(len(tool.compress(plain[len(plain) * i // n : len(plain) * (i + 1) // n])) for i in range(n)), lang))
        (best, lang), (second, _) = sorted(sizes)[:2]
        gap = (second - best) / second
        assert tuple(got[doc_id])[1:] == (lang, pytest.approx(1 - 0.5 / (1 + 20 * gap)), pytest.approx(gap), gap < language_id.MARGIN)


def test_language_of_long_texts_only(spark):
    polish = "szczebrzeszyn chrząszcz brzmi w trzcinie i nie jest to łatwe do powiedzenia dla wszystkich " * 1_000
    rows = [(k, f"{k} {polish}", "pl") for k in range(5)] + [(10 + k, "the house of the man is not here and the dog is away " * 20, "en") for k in range(5)]
    known = language_id.dictionaries(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert set(known) == {"en", "pl"} and 60_000 < len(known["pl"]) <= language_id.DICTIONARY
    asked = spark.createDataFrame([(1, "nie jest to łatwe do powiedzenia"), (2, "the dog is not away")], "doc_id bigint, text string")
    assert {r.doc_id: r.lang_pred for r in language_id.identify(asked, known).collect()} == {1: "pl", 2: "en"}


def test_a_line_that_all_tasks_see(spark):
    """A footer dealt by many tasks stands once in its cells."""
    footer = "all rights reserved by the owner of this site and its partners 2021"
    rows = spark.createDataFrame([(k, f"own text number {k} of this page\n{footer}") for k in range(200)], "doc_id bigint, text string").repartition(60)
    lines = line_dedup.line_prints(line_dedup.with_row(rows), line_dedup.MIN_CHARS)
    kept = line_dedup.one_row_a_line(lines)
    assert kept.groupBy("id").count().filter("count > 1").count() == 0
    assert lines.filter(F.col("cells").isNotNull()).groupBy("id").count().agg(F.max("count")).first()[0] > 20
    assert line_dedup.line_dedup(rows).agg(F.sum("n_removed")).first()[0] >= 199


def test_quality_rules_learn_a_language(spark, sf_dir):
    """Clean texts of a language without a list stay, named or not; junk goes."""
    passage = (
        "w lesie rosną wysokie drzewa i ptaki śpiewają od rana do wieczora a dzieci bawią się na łące która jest pełna kwiatów nie ma tam nikogo kto "
        "by im przeszkadzał więc mogą biegać do woli i zbierać jagody które potem niosą do domu na obiad a babcia robi z nich ciasto"
    ).split()
    draw = np.random.default_rng(11)
    base = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    for lang in ("pl", None):
        clean = [(10**6 + k, lang, " ".join(draw.permutation(passage)[:50]).capitalize() + ".") for k in range(40)]
        junk = [(2 * 10**6 + k, lang, " ".join("".join(draw.choice(list("abcdefghijklmnop"), int(draw.integers(3, 9)))) for _ in range(200))) for k in range(9)]
        rows = base.unionByName(spark.createDataFrame(clean + junk, base.schema))
        words = quality_rules.learned_words(rows, quality_rules.COMMON_WORDS)
        assert list(words) == [quality_rules.LEARNED + (lang or "")] and len(words[quality_rules.LEARNED + (lang or "")]) == 20
        docs_with = Counter(w for _, _, t in clean for w in set(t.lower().split()))
        least = sorted(docs_with.values(), reverse=True)[19]
        assert all(docs_with[w] >= least for w in words[quality_rules.LEARNED + (lang or "")])
        got = {r.doc_id: r.kept for r in quality_rules.quality_rules(rows).collect()}
        assert all(got[i] for i, *_ in clean) and not any(got[i] for i, *_ in junk)


def test_bins_of_all_lists_at_once():
    lists = quality_rules.COMMON_WORDS | {"none": []}
    words = "The the De la la und x Y el El of".split()
    bins = quality_rules.WordLists(lists).bins(np.array([hash(w.encode()) for w in words], np.int64))
    for name, own in lists.items():
        counts = Counter(w.lower() if w.lower() in own and w in (w.lower(), w.capitalize()) else "" for w in words)
        assert bins[name].tolist() == [counts[w] for w in own] + [counts[""]]
    assert quality_rules.WordLists({}).bins(np.array([1, 2], np.int64)) == {}


def test_mixing_rows_without_ids_and_clashing_columns(spark):
    """Rows of null and equal ids have keys of their own; columns with the names of helpers pass through."""
    extra = ("src", "bucket", "start", "wanted", "in_bucket", "bucket_start")
    rows = [(None if k % 2 else 7, f"text number {k} of the table", "ab"[k % 2], *([f"own {k}"] * len(extra))) for k in range(40)]
    got = mixing.curriculum(spark.createDataFrame(rows, "doc_id bigint, text string, source string, " + ", ".join(f"{c} string" for c in extra)))
    found = got.collect()
    assert len({r.order_key for r in found}) == 40
    assert sorted(tuple(r[c] for c in ("doc_id", "text", "source", *extra)) for r in found if r.doc_id) == sorted(r for r in rows if r[0])
    assert all(r.src == f"own {r.text.split()[2]}" for r in found)


def test_decontaminate_items_of_all_lengths(spark):
    """What is found of a short item depends neither on the long ones beside it nor on the shards."""
    draw = np.random.default_rng(7)
    words = [f"term{k}" for k in range(4_000)]
    short, middle, long = (" ".join(draw.choice(words, n, replace=False)) for n in (20, 200, 1_000))
    filler = " ".join(f"filler{k}" for k in range(300))
    first, last = " ".join(short.split()[:10]), " ".join(short.split()[10:])
    docs = [
        (1, f"{filler} {short} {filler}"), (2, f"{filler} {first} {filler} {last} {filler}"), (3, f"{filler} {long} {filler}"), (4, f"{long[: len(long) // 2]} {filler}"),
        (5, f"{middle} {filler}"), (6, f"{first} of {last}"),
    ]
    rows = spark.createDataFrame(docs, "doc_id bigint, text string")
    tests = [(1, short), (2, middle), (3, long)]
    alone = set()
    for test in tests:
        got = decontaminate.contaminated(rows, spark.createDataFrame([test], "item_id bigint, text string"))
        alone |= {(r.doc_id, r.item_id) for r in got.collect()}
    assert {(1, 1), (3, 3), (5, 2)} <= alone and not {(2, 1), (4, 3)} & alone
    for shard_words in (decontaminate.SHARD_WORDS, 300, 20):
        got = decontaminate.contaminated(rows, spark.createDataFrame(tests, "item_id bigint, text string"), shard_words=shard_words)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == alone
