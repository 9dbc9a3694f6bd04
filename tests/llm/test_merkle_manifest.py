"""The Merkle manifest against a plain tree in memory."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ranklab.llm import catalog, merkle_manifest
from ranklab.llm.common import crc_mod, documents


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    def part(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"
    return sha(*(part(x) for x in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def way(levels, i):
    out = []
    for nodes in levels[:-1]:
        lo = i // 3 * 3
        out.append((nodes[lo:i], nodes[i + 1:lo + 3]))
        i //= 3
    return out


def expected(rows):
    by_source = defaultdict(list)
    for r in rows:
        by_source[r["source"]].append(r)
    trees = {}
    for s, rs in by_source.items():
        rs.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees[s] = tree([leaf(r, r["text"]) for r in rs])
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for j, s in enumerate(names):
        for i, r in enumerate(by_source[s]):
            path = way(trees[s], i) + way(top, j)
            odd = r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 2
            acc = leaf(r, r["text"] if odd or r["text"] is None else r["text"].replace("\n", ""))
            for before, after in path:
                acc = sha(*before, acc, *after)
            proof = sha(*(x for before, after in path for x in before + after))
            out.append((r["doc_id"], trees[s][0][i], trees[s][-1][0], top[-1][0], proof, acc, acc == top[-1][0]))
    return Counter(out)


def proofs(docs):
    tampered = F.when(crc_mod("doc_id", 2) == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return merkle_manifest.proofs(merkle_manifest.build(docs, claims={"text": tampered}))


def got(df):
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return Counter(tuple(r) for r in df.collect())


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    out = got(catalog.op12_dag_manifest(spark, sf))
    assert out == expected([r.asDict() for r in documents(spark, sf).collect()])
    assert {v for *_, v in out} == {True, False}


@pytest.mark.parametrize("levels", [1, 2])
def test_odd_rows_over_many_pages(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle_manifest, "PAGE_LEVELS", levels)
    monkeypatch.setattr(merkle_manifest, "RANGE_ROWS", 20)
    rows = [(i, "hot", "en", i, f"text {i}\nline") for i in range(200)]
    rows += [(1000 + i, f"s{i}é", None, None, None) for i in range(30)]
    rows += [(None, None, "de", 3, "no\nname"), (None, "hot", None, None, ""), (None, "hot", None, None, "b"), (7, "", "x", 1, "\n"),
             (2000, "one", "en", 5, "x" * 300_000), (-5, "two", "en", 5, "a\nb"), (8, "two", "en", 5, "a")]
    rows += [(9, "copies", "en", 1, "same\nrow")] * 40
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    docs = docs.repartition(7).withColumns({c: F.lit("x") for c in ("slice", "leaf", "tree", "rank", "row", "src", "claim")})
    assert got(proofs(docs)) == expected([dict(zip(names, r)) for r in rows])


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 10, 28])
def test_small_tables(spark, n):
    rows = [(i, "s", "en", 1, f"{i}\n") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert got(proofs(docs)) == expected([dict(zip(docs.columns, r)) for r in rows])
