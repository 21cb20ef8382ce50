"""Near duplicates against all pairs, signatures against exact similarity, and edge cases."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa

from tillscope.llm import minhash
from tillscope.llm.texts import bare, split_words


def elements(text):
    words = [bare(w) or w for w in (text or "").split()]
    count = Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()
    return frozenset((k, j) for k, n in count.items() for j in range(n))


def classes(rows):
    """Counter of (id, class id) by comparing all pairs."""
    sets, root = [elements(text) for _, text in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if (not a and not b) or (both and both >= 0.8 * (len(a) + len(b) - both)):
                root[find(i)] = find(j)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            smallest[find(i)] = min(smallest.get(find(i), doc), doc)
    return Counter((doc, smallest.get(find(i))) for i, (doc, _) in enumerate(rows))


def words(draw, n):
    return ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 7))) for _ in range(n)]


def edited(draw, text, n):
    text = list(text)
    for _ in range(n):
        text[draw.randrange(len(text))] = words(draw, 1)[0]
    return text


def test_documents_equal_all_pairs(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    found = Counter(tuple(r) for r in minhash.duplicate_classes(documents).collect())
    assert found == classes(rows)


def test_large_group_and_chains(spark, monkeypatch):
    # Edits of edits: many are close to one another but not to the hub, in more than one block.
    monkeypatch.setattr(minhash, "BLOCK", 8)
    draw = random.Random(3)
    base = words(draw, 120)
    texts = [edited(draw, base, draw.randint(0, 12)) for _ in range(60)]
    chain = words(draw, 120)
    for _ in range(25):
        texts.append(chain)
        chain = edited(draw, chain, 1)
    texts += [base[:60] + words(draw, 60) for _ in range(15)]
    texts += [words(draw, 40) for _ in range(10)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    draw.shuffle(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in minhash.duplicate_classes(table).collect()) == classes(rows)


EDGES = [
    (1, ""), (2, None), (3, "one two"), (4, "One, two!"), (None, "no id here but a few words"), (None, None),
    (5, "a b c d e f g"), (5, "a b c d e f g"), (5, "other words under the same id"), (6, "| * | *"),
]


def test_edge_cases(spark):
    table = spark.createDataFrame([(*r, "x") for r in EDGES], "doc_id long, text string, node string")
    assert Counter(tuple(r) for r in minhash.duplicate_classes(table).collect()) == classes(EDGES)
    kept = minhash.keep_one(table)
    assert kept.columns == table.columns
    assert Counter((r[0], r[1]) for r in kept.collect()) == Counter(
        [(1, ""), (3, "one two"), (None, EDGES[4][1]), (5, EDGES[6][1]), (5, EDGES[8][1]), (6, "| * | *")]
    )
    assert minhash.duplicate_classes(table.limit(0)).collect() == []
    assert minhash.keep_one(table.limit(0)).collect() == []


def test_signatures_estimate_weighted_similarity():
    draw = np.random.default_rng(5)
    item, agree, exact = draw.integers(1, 2**62, 300).astype(np.uint64), [], []
    for _ in range(40):
        one, two = draw.integers(0, 6, 300) * 0.7, draw.integers(0, 6, 300) * 0.7
        two = np.where(draw.random(300) < 0.7, one, two)
        row = np.repeat([0, 1], 300)
        weight = np.concatenate([one, two])
        some = weight > 0
        lines = minhash.throw_darts(row[some], np.tile(item, 2)[some], weight[some], 2)
        agree.append((lines[0] == lines[1]).mean())
        exact.append(np.minimum(one, two).sum() / np.maximum(one, two).sum())
    assert abs(np.mean(agree) - np.mean(exact)) < 0.02
    assert np.abs(np.subtract(agree, exact)).max() < 0.2


def test_every_coordinate_is_hit():
    lines = minhash.throw_darts(np.array([0, 2]), np.array([7, 7], np.uint64), np.array([1.0, 1.0]), 3)
    assert (lines[0] != 0).all() and (lines[0] == lines[2]).all() and (lines[1] == 0).all()


def test_shingles_count_repeats():
    row, key, count = minhash.shingles(split_words(pa.array(["a a a a a a a", "a b", "", "c"])))
    assert row.tolist() == [0, 1, 3] and count.tolist() == [3, 1, 1] and len(set(key.tolist())) == 3


def block(rows):
    line, names = bytes(range(minhash.COORDINATES)), ["node", "label", "distance", "elements"]
    frame = pd.DataFrame(rows, columns=names).assign(side=0, band=0, short=[line] * len(rows))
    return sorted(minhash.compare_block(frame).itertuples(index=False, name=None))


def test_blocks_give_links_that_distances_and_elements_allow():
    many = np.arange(100, dtype="<u4")
    same, near, other = many.tobytes(), many[:85].tobytes(), (many + 50).tobytes()
    # The distances of 3 rule it out, the elements of 4 are too few in common, 5 is of the class of 1.
    rows = [(1, 1, 0.3, same), (2, 2, 0.25, near), (3, 3, 0.9, same), (4, 4, 0.3, other), (5, 1, 0.3, same)]
    assert len(block(rows)) == 1 and set(block(rows)[0]) in ({1, 2}, {2, 5})
    # What is joined already needs no more links.
    assert len(block([(i, i, 0.3, same) for i in range(30)])) == 29
    assert block([(1, 1, 0.3, same)]) == []


def test_pairs_are_compared_in_the_first_band_whose_key_they_share():
    # The short signatures agree in band 0 by a clash; the bucket is that of band 1.
    short = bytes(minhash.COORDINATES)
    elements = np.arange(50, dtype="<u4").tobytes()
    bands = [np.arange(minhash.BANDS) + 100, np.arange(minhash.BANDS) + 200]
    bands[1][[1, 3]] = bands[0][[1, 3]]
    rows = [(0, k, k, np.nan, short, bands[k], elements) for k in (0, 1)]
    columns = ["side", "node", "label", "distance", "short", "bands", "elements"]
    found = {}
    for band in (0, 1, 3):
        block = pd.DataFrame(rows, columns=columns).assign(band=band)
        found[band] = [sorted(p) for p in minhash.compare_block(block).to_numpy().tolist()]
    assert found == {0: [], 1: [[0, 1]], 3: []}


def test_short_signatures_do_not_follow_the_coordinate():
    draw = random.Random(11)
    texts = [" ".join(words(draw, 60)) for _ in range(64)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(64)), "text": texts, "text_hash": list(range(64))})
    lines = [line.as_py() for part in minhash.sketch_batches([batch]) for line in part.column("short")]
    short = np.frombuffer(b"".join(lines), np.uint8).reshape(64, minhash.COORDINATES)
    assert (np.array([len(np.unique(c % 8)) for c in short.T]) > 4).all()
    clash = np.mean([(short[i] == short[j]).mean() for i in range(64) for j in range(i)])
    assert clash < 0.01
