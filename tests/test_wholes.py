"""How often inputs are read, how much of them, and by how many tasks."""

import csv
import json
import logging
import random

import pytest
from pyspark.sql import functions as F

from tablescout.operators.collection import Collection, Dataset
from tablescout.operators.index import ContentIndex
from tablescout.operators.ordering import numbered, running
from tablescout.operators.results import display_lines, each_dict, to_dicts
from tablescout.operators.search import keyword_search, keyword_searches
from tablescout.operators.words import content_index
from tablescout.plans.query import DiscoveryEngine
from tablescout.sources import csvtext
from tablescout.sources.files import load_collection, load_folder
from tablescout.sources.scratch import BROADCAST, stored
from tablescout.sources.tables import load_tables


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def watched(frame, seen):
    """The frame, counting the rows that are read of it."""

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return frame.mapInArrow(run, frame.schema)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def odd_csv(path, r, rows, newline):
    cells = ["a", '"q"', '"two\nlines"', '"x ""y"" z"', '5" pipe', '"a,b"', "é", ' "s', '"\n"', '"""\n"""']
    lines = ['h1,"h\n2",h3'] + [",".join(r.choice(cells) if r.random() < 0.97 else '"' + "long\n" * r.randint(0, 2500) + '"' for _ in range(3)) for _ in range(rows)]
    path.write_text(newline.join(lines) + newline * r.randint(0, 3), newline="")
    with path.open(newline="") as f:
        return [tuple(x) for x in csv.reader(f) if x][1:]


@pytest.mark.parametrize("most", [BROADCAST, -1])
def test_line_breaks_in_many_splits(spark, tmp_path, small_splits, monkeypatch, most):
    """Records across splits as the csv module reads them; states of splits by broadcast and by shuffle."""
    monkeypatch.setattr("tablescout.sources.scratch.BROADCAST", most)
    r = random.Random(7)
    want = {k: odd_csv(tmp_path / f"f{k}.csv", r, 150, "\r\n" if k == 2 else "\n") for k in range(3)}
    paths = [f"{tmp_path}/f{k}.csv" for k in want]
    assert csvtext.split_states(spark, paths).where("inside").count() > 3
    got = csvtext.parsed(csvtext.records(spark, paths), 3).collect()
    for k, rows in want.items():
        assert sorted(tuple(x or "" for x in g[:3]) for g in got if g.file.endswith(f"f{k}.csv")) == sorted(rows)


def test_lines_that_stay_open():
    for line, inside, after in [("a,b", False, False), ('"a,b', False, True), ('5" x,y', False, False), ('a,"b', False, True), ('b",c', True, False), ('b"",c', True, True), ('b"",c",d', True, False), ('b",5",c', True, False), ('",",', True, True), ('"",""', False, False), ('"""', False, True), ("", True, True), ('x"y,"z', False, True)]:
        assert csvtext.stays_open(line, inside) is after, (line, inside)


def test_only_files_with_breaks_are_cut_anew(spark, tmp_path, small_splits):
    (tmp_path / "plain.csv").write_text("a,b\n" + "".join(f"word{chr(97 + i % 26)},x\n" for i in range(2000)))
    (tmp_path / "stray.csv").write_text("a\n" + "".join(f'{i}" pipe\n' for i in range(999)))
    (tmp_path / "broken.csv").write_text('a,"b\nc"\n' + "".join(f'"break\nhere",{i}\n' for i in range(500)))
    from tablescout.sources.files import inventory

    listed, _ = inventory(spark, [f"{tmp_path}/{n}.csv" for n in ("plain", "stray", "broken")])
    assert {r.file: (r.breaks, r.width) for r in listed.collect()} == {"plain.csv": (False, 2), "stray.csv": (True, 1), "broken.csv": (True, 2)}
    many = load_collection(spark, str(tmp_path), include_metadata=False)
    assert "multiLine=true" not in plan(many.cells) and many.cells.rdd.getNumPartitions() > 4
    counts = {(r.dataset_name, r.word): r.cnt for r in content_index(many).collect()}
    assert counts["broken", "break"] == counts["broken", "here"] == 500 and counts["stray", "pipe"] == 999 and counts["plain", "worda"] == 77
    one = Collection.of(spark, load_folder(spark, str(tmp_path), include_metadata=False, multiline=True).values())
    assert {(r.dataset_name, r.word): r.cnt for r in content_index(one).collect()} == counts


def test_many_small_files(spark, tmp_path, monkeypatch):
    """The driver opens none of them; faults come in the order of names."""
    for i in range(300):
        (tmp_path / f"d{i:03}.csv").write_text(f"a,b\nword{chr(97 + i % 26)},x\n" if i % 2 else "one\ntwo words\n")
        (tmp_path / f"d{i:03}_metadata.json").write_text(json.dumps({"title": f"T {i}", "description": "été", "n": i}))
    many = load_collection(spark, tmp_path.as_uri())
    rows = many.catalog.orderBy("ord").collect()
    assert [r.dataset_name for r in rows] == [f"d{i:03}" for i in range(300)] and json.loads(rows[7].raw_metadata) == {"title": "T 7", "description": "été", "n": 7}
    assert plan(many.cells).count("Scan csv") == 2 and content_index(many).where("word = 'two'").count() == 150
    assert keyword_search(many, "été 7", True).where("score = 2").count() == 1
    (tmp_path / "d100_metadata.json").write_text('{"title": 5}')
    (tmp_path / "d200_metadata.json").write_text("{")
    with pytest.raises(TypeError, match="d100"):
        load_collection(spark, tmp_path.as_uri())
    (tmp_path / "d050_metadata.json").write_text("")
    with pytest.raises(json.JSONDecodeError):
        load_collection(spark, tmp_path.as_uri())


def test_searches_read_once(spark):
    rows = [(f"d{i % 5}", f"alpha {'beta' if i % 3 else 'gamma'} word{i}") for i in range(60)]
    cells = spark.createDataFrame(rows, "dataset_name string, cell string")
    plain = Collection.of(spark, [Dataset(f"d{k}", spark.range(0), {"title": "alpha", "description": f"beta {k}"} if k % 2 else None) for k in range(5)])
    for in_metadata in (False, True):
        seen, entries = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
        collection = Collection(watched(plain.catalog, entries), watched(cells, seen))
        found = list(DiscoveryEngine(collection).run("semantic:alpha,vector:x,semantic:beta beta,semantic:zzz,semantic:", in_metadata))
        got = [{r.dataset_name: r.score for r in x.frame.collect()} for x in found if x.operation.name == "semantic"]
        if in_metadata:
            assert got == [{f"d{k}": 1 if k % 2 else 12 for k in range(5)}, {f"d{k}": 2 if k % 2 else 16 for k in range(5)}, {f"d{k}": 0 for k in range(5)}, {f"d{k}": 0 for k in range(5)}]
        else:
            assert got == [{f"d{k}": 12 for k in range(5)}, {f"d{k}": 16 for k in range(5)}, {f"d{k}": 0 for k in range(5)}, {f"d{k}": 0 for k in range(5)}]
        assert (seen.value, entries.value) == (60, 5)
        assert [[r["rank"] for r in x.frame.orderBy("rank").collect()] for x in found if x.operation.name == "semantic"] == [[1, 2, 3, 4, 5]] * 4


def test_searches_of_long_queries_shuffle(spark, monkeypatch):
    """Beyond what is broadcast, with entries in the same join."""
    monkeypatch.setattr("tablescout.operators.search.BROADCAST_CHARS", 0)
    c = Collection.of(spark, [Dataset("a", spark.createDataFrame([("x yes",)], "c string"), {"title": "yes", "description": "no"}), Dataset("b", spark.createDataFrame([("yes yes no",)], "c string"))])
    got = {(r.query, r.dataset_name): (r.score, r["rank"]) for r in keyword_searches(c, ["yes", "no yes", ""], True).collect()}
    assert got == {(0, "a"): (1, 2), (0, "b"): (2, 1), (1, "a"): (2, 1), (1, "b"): (2, 2), (2, "a"): (0, 1), (2, "b"): (0, 2)}


def test_index_counts_only_what_changed(spark, tmp_path):
    names = [f"t{k}" for k in range(6)]
    seen = {n: spark.sparkContext.accumulator(0) for n in names}
    frames = {n: watched(spark.createDataFrame([(f"alpha beta word{n}",)] * 4, "c string"), seen[n]) for n in names}
    given = {n: Dataset(n, frames[n]) for n in names}
    index = ContentIndex.build(Collection.of(spark, given.values()), f"{tmp_path}/index", buckets=8)
    new = given["t3"].with_data(watched(spark.createDataFrame([("gamma beta",), ("gamma",)], "c string"), seen["t3"]))
    assert new.id == given["t3"].id
    index = index.replaced([new]).removed(["t5"])
    assert {n: a.value for n, a in seen.items()} == {n: 6 if n == "t3" else 4 for n in names}
    after = Collection.of(spark, [new if n == "t3" else given[n] for n in names[:5]])
    for i in (index, ContentIndex.open(spark, f"{tmp_path}/index", buckets=8), index.compact(f"{tmp_path}/packed")):
        for query, top in (("gamma beta", True), ("alpha", False)):
            assert keyword_search(after, query, top=top, index=i).collect() == keyword_search(after, query, top=top).collect()
    assert index.compact(f"{tmp_path}/again").counts().count() == content_index(after).count() and index.top_words(12).count() == 5
    assert "PartitionFilters: [isnotnull(bucket" in plan(index.counts(["gamma"])) or "PartitionFilters: [(bucket" in plan(index.counts(["gamma"]))
    with pytest.raises(FileNotFoundError):
        ContentIndex.open(spark, f"{tmp_path}/none")


def test_numbers_and_sums_over_ranges(spark):
    r = random.Random(3)
    rows = [(k, r.randint(0, 5)) for k in range(200)]
    frame = stored(spark.createDataFrame(rows, "k long, w int").repartition(7), "t")
    order = sorted(rows, key=lambda x: (-x[1], x[0]))
    for each in (1000, 13):
        got = numbered(frame, F.desc("w"), F.col("k"), name="n", each=each)
        assert [(x.k, x.w) for x in got.orderBy("n").collect()] == order and sorted(x.n for x in got.collect()) == list(range(1, 201))
        sums = {x.n: x.s for x in running(got, "n", "w", "s", each=each).collect()}
        assert sums == {n + 1: sum(w for _, w in order[:n]) for n in range(200)}


def test_display_needs_no_pairs(spark):
    c = Collection.of(spark, [Dataset(f"d{k}", spark.createDataFrame([("yes " * k + "other",)], "c string")) for k in range(4)])
    found = keyword_search(c, "yes")
    for repeat in (False, True):
        lines = display_lines(found, "yes", repeat)
        assert "NestedLoop" not in plan(lines) and "Cartesian" not in plan(lines)
        assert [r.line_no for r in lines.orderBy("line_no").collect()] == list(range(1, lines.count() + 1))
    assert list(each_dict(found)) == to_dicts(found)


def test_tables_of_a_folder(spark, tmp_path):
    """As many scans as schemas; a column of two types parts them."""
    for k in range(12):
        spark.createDataFrame([(f"alpha w{k}x", k)], "a string, n long").coalesce(1).write.parquet(f"{tmp_path}/part {k}+.parquet")
    spark.createDataFrame([("beta", True)], "b string, flag boolean").write.parquet(f"{tmp_path}/z.parquet")
    many = load_tables(spark, tmp_path.as_uri())
    assert plan(many.cells).count("Scan parquet") == 1
    counts = {(r.dataset_name, r.word): r.cnt for r in content_index(many).collect()}
    assert counts["z", "beta"] == counts["z", "true"] == 1 and counts["part 3+", "alpha"] == 1 and len(counts) == 14
    spark.createDataFrame([(5, "gamma")], "a int, b string").write.parquet(f"{tmp_path}/y.parquet")
    parted = load_tables(spark, str(tmp_path))
    assert plan(parted.cells).count("Scan parquet") <= 4
    assert {(r.dataset_name, r.word) for r in content_index(parted).collect()} == set(counts) | {("y", "gamma")}
    with pytest.raises(FileNotFoundError):
        load_tables(spark, f"{tmp_path}/none")


def test_operations_are_echoed(spark, caplog):
    c = Collection.of(spark, [Dataset("a", spark.createDataFrame([("x",)], "c string"))])
    with caplog.at_level(logging.INFO, "tablescout.plans.query"):
        list(DiscoveryEngine(c).run("vector:a,foo"))
    assert "Operations: ['vector:a', 'foo']" in caplog.text
