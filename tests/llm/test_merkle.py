"""The manifest against a tree built whole in one process."""

import hashlib
import random

import pytest

from cuelake.llm import merkle

DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string, tree string, at string, tampered string"


def said(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def whole_tree(leaves, arity):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def proof_of(levels, at, arity):
    out = []
    for level in levels[:-1]:
        run = at // arity * arity
        out += [d for i, d in enumerate(level[run : run + arity], run) if i != at]
        at //= arity
    return out


def by_hand(rows, arity):
    """Rows of the manifest from plain lists."""
    langs = {}
    for doc_id, source, lang, n_chars, text, *_, tampered in rows:
        leaf, claimed = (digest(said(doc_id), said(source), said(lang), said(n_chars), said(t)) for t in (text, tampered))
        langs.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf, doc_id, claimed))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: whole_tree([r[2] for r in sorted(langs[lang])], arity) for lang in order}
    top = whole_tree([trees[lang][-1][0] for lang in order], arity)
    out = []
    for k, lang in enumerate(order):
        for at, (_, _, leaf, doc_id, claimed) in enumerate(sorted(langs[lang])):
            proof = proof_of(trees[lang], at, arity) + proof_of(top, k, arity)
            other = whole_tree([r[4] if i == at else r[2] for i, r in enumerate(sorted(langs[lang]))], arity)
            back = whole_tree([other[-1][0] if j == k else trees[x][-1][0] for j, x in enumerate(order)], arity)[-1][0]
            out.append((doc_id, leaf, trees[lang][-1][0], top[-1][0], digest(*proof), back, back == top[-1][0]))
    return sorted(out, key=repr)


def table_of(n, seed):
    rng = random.Random(seed)
    langs = [None, "", "de", "en", "é", *(f"x{i}" for i in range(11))]
    rows = []
    for i in range(n):
        lang = "en" if i % 3 else rng.choice(langs)
        doc_id = rng.choice([None, i, i, i, rng.randrange(40)])
        text = rng.choice([None, "", f"Text {i}", "SAME"])
        rows.append((doc_id, rng.choice([None, "s", ""]), lang, rng.choice([None, i]), text, "x", "y", text if (doc_id or 0) % 2 or text is None else text.lower()))
    return rows + rows[:20]


@pytest.mark.parametrize("n,arity,step", [(300, 8, 3), (300, 2, 2), (90, 3, 1), (0, 8, 3), (1, 8, 3)])
def test_manifest_of_odd_rows(spark, n, arity, step):
    """Nulls everywhere, empty texts, equal ids, repeated rows, clashing names, languages of one row, no rows."""
    rows = table_of(n, n) if n > 1 else [(7, None, None, None, None, "x", "y", None)] * n
    got = merkle.manifest(spark.createDataFrame(rows, DOCS), step=step, arity=arity)
    assert sorted(map(tuple, got.collect()), key=repr) == by_hand(rows, arity)


def test_only_some_levels_are_written(spark):
    rows = [(i, "s", "en", 1, str(i), "x", "y", str(i)) for i in range(100)]
    leaves = merkle.numbered(spark.createDataFrame(rows, DOCS).selectExpr("'en' as tree", "doc_id", "sha2(text, 256) as digest"), "tree", "doc_id")
    levels = merkle.checkpoints(leaves, step=2, arity=2)
    # 100 leaves have levels of 100, 50, 25, 13, 7, 4, 2 and 1 nodes.
    assert [level.count() for level in levels] == [100, 25, 7, 2, 1]


def test_a_long_text(spark):
    rows = [(i, "s", "en", 1, "word " * 400_000, "x", "y", "word " * 400_000) for i in range(3)]
    assert all(r.verified for r in merkle.manifest(spark.createDataFrame(rows, DOCS)).collect())
