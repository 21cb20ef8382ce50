"""The Merkle manifest against a plain tree, over many rounds, odd rows and ties."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tillscope.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, place int"


def h(parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def plain_proof(leaves, place):
    """Top of a tree and the siblings of each level, as (left, right)."""
    way = []
    while len(leaves) > 1:
        start = place - place % 8
        run = leaves[start : start + 8]
        way.append((run[: place - start], run[place - start + 1 :]))
        leaves, place = [h(leaves[i : i + 8]) for i in range(0, len(leaves), 8)], place // 8
    return leaves[0], way


def plain_manifest(rows, tampered):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    order = sorted(trees, key=lambda lang: (lang is not None, (lang or "").encode()))
    leaves = {}
    for lang in order:
        trees[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        leaves[lang] = [plain_leaf(r) for r in trees[lang]]
    subroots = [plain_proof(leaves[lang], 0)[0] for lang in order]
    answer = []
    for number, lang in enumerate(order):
        for place, row in enumerate(trees[lang]):
            subroot, way = plain_proof(leaves[lang], place)
            root, top = plain_proof(subroots, number)
            way = way + top
            text = row[4]
            changed = tampered(row[0])
            if changed and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = plain_leaf((*row[:4], text))
            for left, right in way:
                node = h([*left, node, *right])
            proof = h("".join(left + right) for left, right in way)
            answer.append((row[0], leaves[lang][place], subroot, root, proof, node, node == root, len(way) + 1 if changed else 0))
    return answer


def third(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0


def rows_of(n):
    rows = [
        (i, f"s{i % 3}" if i % 11 else None, ["en", "de", "Ä", "z"][i % 7 % 4], i if i % 5 else None, f"Text {i} É" if i % 2 else f"text {i}")
        for i in range(n)
    ]
    rows += [(None, "s", None, 3, "No id A"), (5, "s", None, None, None), (7, "", "lone", 0, ""), (9, "s", "en", 1, "Twice A"), (9, "s", "en", 1, "Twice A")]
    rows += [(9, "s", "en", 1, "Another of the same id"), (10**15, "s", "", 1, "Long " * 50_000), (None, None, None, None, None)]
    return rows


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_manifest_equals_a_plain_tree(spark, levels):
    rows = rows_of(700)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    found = [tuple(r) for r in merkle.merkle_manifest(table, levels=levels).collect()]
    expected = plain_manifest(rows, third)
    key = lambda r: tuple(map(str, r))
    assert sorted(found, key=key) == sorted(expected, key=key)
    verified = {r[0]: r[6] for r in found}
    assert not verified[10**15] if third(10**15) else verified[10**15]
    assert 0 < sum(not r[6] for r in found) < len(found) / 2


def test_each_version_changes_one_leaf_only(spark):
    rows = [(i, "s", "en", 1, "CAPITAL") for i in range(80)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    found = merkle.merkle_manifest(table, F.col("doc_id") == 17, levels=1).collect()
    assert [r["doc_id"] for r in found if not r["verified"]] == [17]
    # The leaf, two levels within the language, the subroot, and no level above a single subroot.
    assert {r["doc_id"]: r["copied_nodes"] for r in found if r["copied_nodes"]} == {17: 4}


def test_small_and_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.merkle_manifest(empty).collect() == []
    one = spark.createDataFrame([(1, "s", "en", 1, "a", "x", 1)], SCHEMA)
    row = merkle.merkle_manifest(one).first()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["verified"]
    assert row["proof_sha256"] == sha256(b"").hexdigest()


def test_a_language_over_many_slices(spark):
    rows = [(i, "s", "en" if i % 10 else None, i, f"T{i}") for i in range(3000)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    leaves = merkle.numbered(merkle.leaves_of(table, F.lit(False)), ["doc_id", "leaf"])
    places = sorted((r["tree"], r["place"], r["doc_id"], r["nodes"]) for r in leaves.collect())
    expected = [("0", i, 10 * i, 300) for i in range(300)]
    assert places == expected + [("1en", i, d, 2700) for i, d in enumerate(d for d in range(3000) if d % 10)]
