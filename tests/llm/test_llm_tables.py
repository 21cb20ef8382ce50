"""Token rollups, licence scan, decontamination, the pipeline and the registered queries."""

import re
import sys
from pathlib import Path

import duckdb
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parent.parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

import check_queries  # noqa: E402
import corpus_pipeline  # noqa: E402

from tillscope.llm import bpe, decontaminate, licenses, minhash, quality_rules, token_counts  # noqa: E402
from tillscope.llm.queries import ORACLE, QUERIES  # noqa: E402

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def totals(rollup):
    return {(r["source"], r["lang"], r["version"]): (r["documents"], r["tokens"]) for r in rollup.totals().collect()}


def test_rollup_follows_changes(spark, tmp_path):
    rollup = token_counts.TokenRollup(spark, str(tmp_path))
    assert totals(rollup) == {}
    rows = [(1, "a b c.", "en", "s"), (2, None, "en", "s"), (3, "é é", None, "t"), (3, "é é", None, "t"), (None, "x", "en", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    load = token_counts.count_tokens(table, "insert")
    assert rollup.commit("one", load)
    first = totals(rollup)
    assert first[("s", "en", "words-v1")] == (2, 3) and first[("s", "en", "pieces-v2")] == (2, 4)
    assert first[("t", None, "words-v1")] == (2, 4) and first[(None, "en", "words-v1")] == (1, 1)
    assert not rollup.commit("one", load) and totals(rollup) == first
    # A batch under another name that says the same changes nothing.
    assert rollup.commit("two", load) and totals(rollup) == first
    moved = table.where("doc_id = 1").withColumn("source", F.lit("u"))
    assert rollup.commit("three", token_counts.count_tokens(moved, "revise", F.lit("one two three four")))
    assert totals(rollup)[("s", "en", "words-v1")] == (1, 0) and totals(rollup)[("u", "en", "words-v1")] == (1, 4)
    gone = spark.createDataFrame([(1,), (99,), (None,)], "doc_id long")
    assert rollup.commit("four", token_counts.withdraw(gone))
    assert {k[0] for k in totals(rollup)} == {"s", "t"}
    assert rollup.commit("five", token_counts.withdraw(gone)) and {k[0] for k in totals(rollup)} == {"s", "t"}
    assert rollup.commit("six", load) and totals(rollup) == first


def test_unfinished_batch_counts_for_nothing(spark, tmp_path, monkeypatch):
    rollup = token_counts.TokenRollup(spark, str(tmp_path))
    table = spark.createDataFrame([(1, "a b", "en", "s")], "doc_id long, text string, lang string, source string")
    load = token_counts.count_tokens(table, "insert")
    with monkeypatch.context() as patch:
        patch.setattr(token_counts, "_signed", lambda now, before: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            rollup.commit("one", load)
    assert totals(rollup) == {}
    assert token_counts.TokenRollup(spark, str(tmp_path)).commit("one", load)
    assert totals(rollup)[("s", "en", "words-v1")] == (1, 2)
    assert rollup.commit("empty", load.limit(0))


def test_rollup_counts_rows_that_share_an_id_as_the_sql_does(spark, tmp_path):
    rows = [
        (1, "a b 12", "en", "s"), (1, "a b 12", "en", "s"), (1, "c 3", "fr", "t"), (None, "x 1", "en", "s"), (None, "x 1", "en", "s"),
        (2, "d 4 5", "en", "s"), (2, "d", None, None), (3, "e", "en", "s"), (4, None, "en", "s"), (5, "long " * 300_000, "en", "s"),
    ]
    documents = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, text string, lang string, source string, kind string, tokens int")
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 1), (3, 0, 0), (9, 0, 1), (None, 0, 1)], "doc_id long, quality long, toxic long")
    connection = duckdb.connect()
    for name, table in [("documents", documents), ("labels", labels)]:
        table.write.parquet(f"{tmp_path}/{name}.parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = {tuple(r) for r in QUERIES["op1_token_counts"](spark, str(tmp_path)).collect()}
    assert got == set(connection.execute(ORACLE["op1_token_counts"]).fetchall()) and len(got) > 4


def test_folded_batches_stand_for_all_before(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "FOLD", 2)
    rollup = token_counts.TokenRollup(spark, str(tmp_path))
    rollup.fold()
    schema = "doc_id long, text string, lang string, source string"
    state = {}
    for number in range(3):
        batch = [(i, "w " * (number + i), "en", f"s{i % 2}") for i in range(number, number + 3)]
        state |= {r[0]: r for r in batch}
        change = token_counts.count_tokens(spark.createDataFrame(batch, schema), "insert")
        assert rollup.commit(f"batch {number}", change)
        gone = spark.createDataFrame([(number,)], "doc_id long")
        assert rollup.commit(f"gone {number}", token_counts.withdraw(gone))
        del state[number]
        assert not rollup.commit("batch 0", change) and len(rollup._state()[2]) <= 2
    fresh = token_counts.TokenRollup(spark, f"{tmp_path}/fresh")
    fresh.commit("all", token_counts.count_tokens(spark.createDataFrame(list(state.values()), schema), "insert"))
    assert totals(rollup) == totals(fresh) != {}


def test_counts_of_a_public_tokenizer(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None), (-1, "", "en", "s"), (-2, "é🙂 " * 50_000, "en", "s")], "doc_id long, text string, lang string, source string")
    table = documents.unionByName(odd, allowMissingColumns=True).withColumn("tokens", F.lit("clash"))
    rollup = token_counts.TokenRollup(spark, str(tmp_path))
    change = token_counts.count_encoded(table, "insert", bpe.Vocabulary.read(path), "word-bpe-49k")
    assert rollup.commit("load", change)
    library = tokenizers.Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    want = {}
    for r in table.collect():
        key = (r["source"], r["lang"], "word-bpe-49k")
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        want[key] = tuple(map(sum, zip(want.get(key, (0, 0)), (1, n))))
    assert totals(rollup) == want
    assert rollup.commit("away", token_counts.withdraw(table, ["word-bpe-49k"])) and totals(rollup) == {}


def test_licences_inherit_from_the_nearest_directory(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [
        (1, "a/LICENSE", f"{apache}\nmore"), (2, "a/x.txt", "code"), (3, "a/b/c/y.txt", "code"), (4, "a/b/COPYING", mit),
        (5, "z/x.txt", "code"), (6, "a/own.txt", f"code\n{mit}"), (7, None, None), (8, "top.txt", None), (9, "a/b/c/y.txt", "code"),
        (10, "ab/x.txt", "code"), (11, "q/NOTICE", "no warranty whatsoever is given by anybody for this text"), (12, "q/w.txt", ""),
    ]
    files = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, path string, text string, license string")
    got = {r["doc_id"]: (r["license"], r["origin"], r["from_directory"]) for r in licenses.scan_licenses(files).collect()}
    assert got == {
        1: ("Apache-2.0", "header", None), 2: ("Apache-2.0", "inherited", "a"), 3: ("MIT", "inherited", "a/b"),
        4: ("MIT", "header", None), 5: (None, "none", None), 6: ("MIT", "header", None), 7: (None, "none", None),
        8: (None, "none", None), 9: ("MIT", "inherited", "a/b"), 10: (None, "none", None), 11: (None, "none", None),
        12: (None, "none", None),
    }
    assert licenses.scan_licenses(files.limit(0)).collect() == []
    cosine = licenses.scan_licenses(files.where("doc_id = 1")).first()["cosine"]
    assert cosine == pytest.approx(1.0)


ITEMS = [
    (1, "Alice has 12 apples and gives 5 km of rope to Bob because Alice likes 12 apples a lot."),
    (2, "What is the speed of a train that runs 30 miles in 2 hours and then stops?"),
    (3, None), (4, ""), (5, "Tiny xyzzy one"),
]
TEXTS = [
    (10, "Intro. Carol has 7 apples and gives 9 m of rope to Dan because Carol likes 7 apples a lot. End"),
    (11, "Carol has 7 apples and gives 9 m of rope to Dan because Erin likes 8 apples a lot."),
    (12, "what is the speed of a train that runs 55 km in 3 minutes and then stops"),
    (13, "We saw a tiny xyzzy one there"), (None, "What is the speed of a train that runs 1 mile in 2 hours and then stops"),
    (14, None), (15, ""), (10, "another text of the same id"),
]


def test_questions_with_other_numbers_and_names(spark):
    documents = spark.createDataFrame([(*t, "x") for t in TEXTS], "doc_id long, text string, text_hash string")
    items = spark.createDataFrame([(*i, 1) for i in ITEMS], "item_id long, text string, place int")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaked_items(documents, items).collect()}
    # 11 names two people where the item names one, and changes 12 into two numbers.
    assert found == {(10, 1), (12, 2), (13, 5), (None, 2)}
    kept = decontaminate.drop_leaks(documents, items)
    assert kept.columns == documents.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == [
        (10, TEXTS[7][1]), (11, TEXTS[1][1]), (14, ""), (15, ""),
    ]
    assert decontaminate.leaked_items(documents.limit(0), items).collect() == []
    assert decontaminate.leaked_items(documents, items.limit(0)).collect() == []


STARTS = (
    "Maria has 5 red apples in her basket today. Maria buys 7 more apples at the market. "
    "Maria gives 3 of the apples to a friend. Maria wants to know how many are left."
)
NAMED = "On Monday the teacher Alice met with Bob and Carol near Paris to count 14 coins for the school fair."


def test_names_at_sentence_starts_and_copies_in_other_case(spark):
    other = STARTS.replace("Maria", "Carla").replace("5", "8").replace("7", "2").replace("3", "6")
    texts = [
        other, NAMED.lower(), NAMED.upper(), NAMED.replace(" ", "\n"), NAMED.replace(" ", "  "), NAMED.replace(" ", "\u00a0\t"),
        NAMED.lower().replace("14", "15"), "Nothing of the kind stands in this text of more than eight words.",
    ]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, STARTS), (2, NAMED)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["share"] for r in decontaminate.leaked_items(documents, items).collect()}
    assert found == {(0, 1): 1.0} | {(i, 2): 1.0 for i in range(1, 7)}


def test_values_that_coincide_and_one_that_was_changed(spark):
    item = (
        "a farmer has 3 apples and 5 pears in one box and sells 3 apples to a man who then walks away over "
        "the long hill and down to the small town where he eats 5 pears under a tree before he goes home"
    )
    coincide = item.replace("3", "4").replace("5", "4")
    changed = item.replace("sells 3", "sells 9")
    documents = spark.createDataFrame([(1, coincide), (2, changed)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = {r["doc_id"]: (r["n_windows"], r["share"]) for r in decontaminate.leaked_items(documents, items).collect()}
    # Only the 8 windows that hold the changed number are lost.
    windows = len(item.split()) - 7
    assert found == {1: (windows, 1.0), 2: (windows - 8, pytest.approx((windows - 8) / windows))}


def plain_leaks(documents, items, width=8):
    def words(text):
        return [w.lower() for w in re.findall(r"[^\W_]+(?:[.,'’-][^\W_]+)*", text or "")]

    index, size = {}, {}
    for item, text in items:
        own = words(text)
        size[item] = max(1, len(own) - width + 1)
        for i in range(len(own) - width + 1):
            index.setdefault(tuple(own[i : i + width]), set()).add((item, i))
    found = set()
    for doc, text in documents:
        own, hits = words(text), {}
        for i in range(len(own) - width + 1):
            for item, place in index.get(tuple(own[i : i + width]), ()):
                hits.setdefault(item, set()).add(place)
        found |= {(doc, item) for item, places in hits.items() if len(places) >= 0.5 * size[item]}
    return found


def test_leaks_equal_plain_windows(spark):
    # No numbers or names stand in these items, so plain windows are the same.
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaked_items(documents, items).collect()}
    expected = plain_leaks(documents.select("doc_id", "text").collect(), items.select("item_id", "text").collect())
    assert found == expected and found


def test_larger_benchmarks_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "small", lambda df: df)
    documents = spark.createDataFrame(TEXTS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaked_items(documents, items).collect()}
    assert found == {(10, 1), (12, 2), (13, 5), (None, 2)}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, folder, name):
    assert check_queries.compare(spark, check_queries.connect(folder), folder, name) is None


def test_queries_are_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14)) and set(ORACLE) <= set(QUERIES)


def test_pipeline_stage_by_stage(spark, folder, tmp_path):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    typed = " ".join(f"{w} number{i}" for i, w in enumerate(documents.first()["text"].split()[:200]))
    secret = [(10**6, f"{typed} password=b7db7aa4a5fcc78305 {typed[::-1]}", "en", "src1", 1)]
    documents = documents.unionByName(spark.createDataFrame(secret, DOCUMENT))
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    items = spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()
    stages = dict(corpus_pipeline.STAGES)
    results, before = {}, documents
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, folder).write.parquet(f"{tmp_path}/{name}")
        results[name] = (before, spark.read.parquet(f"{tmp_path}/{name}"))
        before = results[name][1]
    assert list(stages) == ["quality_rules", "minhash_dedup", "decontamination", "secret_scan", "bpe_encoding"]
    for name, (_, after) in list(results.items())[:-1]:
        assert after.columns == documents.columns, name

    def ids(df):
        return {r["doc_id"] for r in df.select("doc_id").collect()}

    before, after = results["quality_rules"]
    verdicts = quality_rules.quality_rules(before, labels).where("kept")
    assert ids(after) == ids(verdicts) < ids(before)
    before, after = results["minhash_dedup"]
    assert ids(after) == {r["class_id"] for r in minhash.duplicate_classes(before).collect()} < ids(before)
    before, after = results["decontamination"]
    leaked = {doc for doc, _ in plain_leaks(before.select("doc_id", "text").collect(), items)}
    assert ids(after) == ids(before) - leaked and leaked
    before, after = results["secret_scan"]
    assert ids(after) == ids(before)
    text = {r["doc_id"]: r["text"] for r in after.collect()}
    changed = [r for r in before.collect() if r["text"] != text[r["doc_id"]]]
    assert changed and not any(re.search("AKIA[A-Z0-9]{16}|[0-9a-f]{24}", t) for t in text.values())
    before, after = results["bpe_encoding"]
    assert ids(after) == ids(before) and after.where("n_tokens != size(ids)").isEmpty()


def test_pipeline_on_odd_rows(spark, tmp_path):
    good = " ".join(f"word{i} and" for i in range(60))
    rows = [(1, good, "en", "s", 1), (1, good, "en", "s", 1), (None, good + " more", None, None, None), (2, None, "en", "s", 0), (3, "", "", "", 0)]
    for name, content in [("full", rows), ("empty", [])]:
        path = f"{tmp_path}/{name}"
        spark.createDataFrame(content, DOCUMENT).withColumn("label", F.lit("x")).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(f"{path}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        found = corpus_pipeline.run(spark, path).collect()
        assert [r["doc_id"] for r in found] == ([1] if content else [])


SHORT = [(1, "42"), (2, "Alice"), (3, "Yes"), (4, "12 + 30 = 42"), (5, "1 2 3 4 5 6 7 8 9 10"), (6, "Maria has 5 red apples")]
NEAR = [
    (1, "There are 17 of them"), (2, "There are 42 of them"), (3, "Bob and Carol met"), (4, "we saw ALICE there"), (5, "yes"),
    (6, "1 + 2 = 3 and 12 + 30 = 42"), (7, "11 + 31 = 42"), (8, "3 1 4 1 5 9 2 6 5 3 5 8"), (9, "so 1 2 3 4 5 6 7 8 9 10."),
    (10, "Carla has 7 red apples"), (11, "maria has 5 red apples"), (12, "Yesterday 420 people"),
]


def test_items_of_numbers_and_names_leak_as_they_are_only(spark):
    documents = spark.createDataFrame(NEAR, "doc_id long, text string")
    items = spark.createDataFrame(SHORT, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaked_items(documents, items).collect()}
    assert found == {(2, 1), (6, 1), (7, 1), (4, 2), (5, 3), (6, 4), (9, 5), (11, 6)}


def template_leaks(documents, items, width=8, literals=4):
    """Templates, slots and values by plain Python; texts of single blanks, names within sentences only."""

    def words(text):
        return re.findall(r"[^\W_]+(?:[.,'’-][^\W_]+)*", text or "")

    def templates(text):
        """Per place: (template, values) of each form, and the plain words."""
        own = words(text)
        starts = {m.start() for m in re.finditer(r"(?<=[\w,;)] )(?=[A-Z][a-z])", text or "")}
        at, places = 0, []
        for w in own:
            at = (text or "").index(w, at)
            places.append(at)
            at += len(w)
        forms = []
        for form in range(3):
            canon = []
            for w, place in zip(own, places, strict=True):
                capital = bool(re.match("[A-Z][a-z]", w))
                named = capital and (form == 2 or (form == 1 and place in starts))
                canon.append("<N>" if named else "<0>" if w[0].isdigit() else w.lower())
            forms.append(canon)
        return [w.lower() for w in own], forms

    def windows(text):
        plain, forms = templates(text)
        size = min(width, len(plain))
        for i in range(len(plain) - size + 1 if size else 0):
            for canon in forms:
                part = tuple(canon[i : i + size])
                yield i, part, tuple(p for c, p in zip(part, plain[i : i + size], strict=True) if c[0] == "<"), tuple(plain[i : i + size])

    index, total = {}, {}
    for item, text in items:
        for i, part, values, plain in windows(text):
            total.setdefault(item, set()).add(i)
            few = values and len(part) - len(values) < literals
            index.setdefault(("plain", plain) if few else ("template", part), set()).add((item, i, () if few else values))
    found = set()
    for doc, text in documents:
        met, along = {}, {}
        for i, part, values, plain in windows(text):
            for item, place, own in index.get(("template", part), ()):
                met.setdefault(item, set()).add((place, own, values, i - place))
                for a, b in zip(own, values, strict=True):
                    along.setdefault((item, i - place, a), set()).add(b)
            for item, place, _ in index.get(("plain", plain), ()):
                met.setdefault(item, set()).add((place, (), (), i - place))
        for item, hits in met.items():
            good = {p for p, own, v, s in hits if own == v or all(len(along[item, s, a]) == 1 for a in own)}
            if len(good) >= 0.5 * len(total[item]):
                found.add((doc, item))
    return found


def test_leaks_equal_plain_templates(spark):
    import random

    draw = random.Random(5)
    names, verbs, things = ["Ann", "Bob", "Cleo", "Dan"], ["buys", "sells", "finds"], ["red apples", "old coins", "long sticks of wood"]

    def question():
        a, b, thing = draw.choice(names), draw.choice(names), draw.choice(things)
        n, m = draw.randint(1, 4), draw.randint(1, 4)
        tail = draw.choice([f"and then {a} gives {m} of them to {b} before the end of day {n}", f"while {b} looks on for {m} or {n} more"])
        return f"in the morning {a} {draw.choice(verbs)} {n} {thing} {tail}"

    items = [(i, question()) for i in range(25)]
    documents = [(i, f"some words stand before it, {question()} and some stand after it") for i in range(150)]
    rows = [spark.createDataFrame(r, f"{c} long, text string") for r, c in ((documents, "doc_id"), (items, "item_id"))]
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaked_items(*rows).collect()}
    assert found == template_leaks(documents, items) and found


def test_a_very_long_text_of_questions(spark):
    filler = " ".join(f"filler{i} text" for i in range(60_000))
    documents = spark.createDataFrame([(1, f"{filler} {TEXTS[0][1]}"), (2, filler)], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert [tuple(r)[:2] for r in decontaminate.leaked_items(documents, items).collect()] == [(1, 1)]
