import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quarrylane.llm import merkle
from tests.llm.fixtures import DOC_SCHEMA, awkward

def tampered():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(r, lower=False):
    text = r.text.translate({c: c + 32 for c in range(65, 91)}) if lower and r.text is not None else r.text
    return sha("".join(map(field, (r.doc_id, r.source, r.lang, r.n_chars, text))))


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, i):
    for level in tree[:-1]:
        start = i // 16 * 16
        yield "".join(level[start:i]), "".join(level[i + 1 : start + 16])
        i //= 16


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id or 0, leaf(r), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda x: x[:3])
    trees = {s: levels([x[2] for x in by[s]]) for s in sources}
    upper = levels([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, (_, _, own, r) in enumerate(by[s]):
            path = [*siblings(trees[s], i), *siblings(upper, k)]
            folded = leaf(r, r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
            for left, right in path:
                folded = sha(left + folded + right)
            out.append((r.doc_id, own, trees[s][-1][0], upper[-1][0], sha("".join(a + b for a, b in path)), folded, folded == upper[-1][0]))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("n_sources", [1, 3, 40])
def test_matches_brute_force(spark, n_sources):
    """One hot source, lone leaves and, with 40 sources, two levels above them; one level a deal changes nothing."""
    rows = [(i, f"Text {i}", "en", None if i % 7 == 3 else f"s{i % n_sources if i > 250 else 0}", i) for i in range(330)]
    table = spark.createDataFrame(rows, DOC_SCHEMA)
    want = brute(table.collect())
    assert found(merkle.manifest(table, tampered())) == want
    assert found(merkle.manifest(table.repartition(5), tampered(), levels=1, broadcast_groups=1)) == want
    assert 0 < sum(r[-1] for r in want) < len(want)


def test_awkward_rows(spark):
    table = awkward(spark)
    assert found(merkle.manifest(table, tampered())) == brute(table.collect())
    empty = merkle.manifest(spark.createDataFrame([], DOC_SCHEMA), tampered())
    assert empty.collect() == [] and empty.columns[:2] == ["doc_id", "leaf"]
    one = spark.createDataFrame([(5, None, None, None, None)], DOC_SCHEMA)
    assert found(merkle.manifest(one, tampered())) == brute(one.collect())
    assert merkle.manifest(one).first().proof_sha256 == sha("")


def test_events_in_any_order():
    """Ancestors are built as soon as their last child comes; what is open is given back whole."""
    leaves = [sha(str(i)) for i in range(300)]
    want = levels(leaves)
    partials = merkle.Partials()
    order = [(i * 7) % 300 for i in range(300)]
    nodes = [n for i in order for n in partials.add("g", 300, 0, i, leaves[i])]
    assert {(n[2], n[3]): n[4] for n in nodes} == {(k, i): d for k, level in enumerate(want) if k for i, d in enumerate(level)}
    assert list(partials.frontier()) == []
    partials = merkle.Partials()
    nodes = [n for i in range(299) for n in partials.add("g", 300, 0, i, leaves[i])]
    rest = list(partials.frontier())
    assert len(nodes) == 19 and sorted((n[2], n[3]) for n in rest) == [(0, i) for i in range(288, 299)] + [(1, i) for i in range(16, 18)] + [(2, 0)]
