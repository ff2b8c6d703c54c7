"""The engine's rules on small collections, values worked out by hand."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablescout.functions.text import content_normalize, normalize, tokens
from tablescout.operators.collection import Collection, Dataset
from tablescout.operators.results import display_lines, no_result_message, positive_count, to_dicts
from tablescout.operators.search import keyword_search
from tablescout.operators.words import content_index
from tablescout.plans.query import DiscoveryEngine, parse_query
from tablescout.sources.files import load_collection, load_dataset, load_folder, save_dataset

#: The demonstration rows whose rankings, counts and top words are known by hand; other sentences would have other results.
ROWS = {
    "dataset1": ("This is an example data set with some relevant information.", "Additional info in dataset 1.", "Example Dataset 1", "This is a description of example dataset 1."),
    "dataset2": ("Another dataset that might be relevant to the search query.", "It contains relevant data and information.", "Relevant Dataset", "This dataset is relevant to the query."),
    "dataset3": ("This dataset does not contain much relevant information.", "Irrelevant data.", "Irrelevant Dataset", "This dataset is not relevant."),
}
NAMES = "Column1 string, Column2 string"


def made(spark, without=()):
    return Collection.of(spark, [Dataset(n, spark.createDataFrame([r[:2]], NAMES), None if n in without else {"title": r[2], "description": r[3]}) for n, r in ROWS.items()])


@pytest.fixture(scope="module")
def three(spark):
    return made(spark)


def ranking(collection, query, in_metadata=False):
    return [(r.dataset_name, r.score) for r in keyword_search(collection, query, in_metadata, top=False).orderBy("rank").collect()]


@pytest.mark.parametrize(("query", "in_metadata", "expected"), [
    ("relevant information", False, [("dataset2", 3), ("dataset1", 2), ("dataset3", 2)]),
    ("relevant information", True, [("dataset2", 2), ("dataset3", 1), ("dataset1", 0)]),
    ("1", False, [("dataset1", 0), ("dataset2", 0), ("dataset3", 0)]),
    ("1", True, [("dataset1", 2), ("dataset2", 0), ("dataset3", 0)]),
    ("a of", True, [("dataset1", 2), ("dataset2", 0), ("dataset3", 0)]),
    ("relevant relevant", True, [("dataset2", 4), ("dataset3", 2), ("dataset1", 0)]),
    ("RELEVANT!", True, [("dataset2", 2), ("dataset3", 1), ("dataset1", 0)]),
    ("", False, [("dataset1", 0), ("dataset2", 0), ("dataset3", 0)]),
    ("column1", False, [("dataset1", 0), ("dataset2", 0), ("dataset3", 0)]),
])
def test_rankings(three, query, in_metadata, expected):
    assert ranking(three, query, in_metadata) == expected


def test_top_words_and_results(three):
    found = to_dicts(keyword_search(three, "relevant information"))
    assert list(found[0]["top_words"].items()) == [("relevant", 2)] + [(w, 1) for w in "and another contains data dataset information might query search".split()]
    assert list(found[1]["top_words"]) == "additional data dataset example info information relevant set some this".split()
    assert all(r["metadata"] is None for r in found)
    in_meta = to_dicts(keyword_search(three, "relevant", True))
    assert all(r["top_words"] is None for r in in_meta) and json.loads(in_meta[0]["metadata"])["title"] == "Relevant Dataset"
    assert {r.dataset_name: r.n for r in content_index(three).groupBy("dataset_name").agg(F.count("*").alias("n")).collect()} == {"dataset1": 11, "dataset2": 12, "dataset3": 10}
    assert positive_count(keyword_search(three, "relevant information")).first() == (True, 3)
    assert positive_count(keyword_search(three, "relevant information", True)).first() == (True, 2)


def test_index_gives_the_same(three):
    index = content_index(three)
    for top in (True, False):
        assert keyword_search(three, "relevant data", index=index, top=top).collect() == keyword_search(three, "relevant data", top=top).collect()


def test_fallback_to_content(spark):
    some = made(spark, without=("dataset2",))
    found = {r.dataset_name: r for r in keyword_search(some, "relevant 1 a", True).collect()}
    assert [(n, found[n].score, found[n].used_metadata) for n in sorted(found)] == [("dataset1", 3, True), ("dataset2", 2, False), ("dataset3", 1, True)]
    assert found["dataset2"].top_words is None and found["dataset2"].metadata is None


def test_empty_and_odd_datasets(spark):
    odd = Collection.of(spark, [
        Dataset("empty", spark.createDataFrame([], NAMES), {}),
        Dataset("nulls", spark.createDataFrame([(None, "true story")], NAMES)),
        Dataset("types", spark.createDataFrame([(1, True, 2.5)], "a int, `b.c` boolean, d double")),
        Dataset("numbers", spark.createDataFrame([(1,)], "a int")),
    ])
    assert dict(ranking(odd, "true")) == {"empty": 0, "nulls": 1, "types": 1, "numbers": 0}
    assert dict(ranking(odd, "true", True)) == {"empty": 0, "nulls": 1, "types": 1, "numbers": 0}
    assert ranking(Collection.of(spark, []), "x") == []
    with pytest.raises(TypeError):
        Collection.of(spark, [Dataset("a", spark.range(1), {"title": None})])


def test_normalize(spark):
    got = spark.createDataFrame([("Snake_case, OURÉAUX--x 1!",), ("",), (None,), ("  ",)], "t string").select(tokens(normalize(F.col("t"))), tokens(content_normalize(F.col("t")))).collect()
    assert [r[0] for r in got] == [["snake_case", "ouréaux", "x", "1"], [], None, []]
    assert all(r[0] == r[1] for r in got)


def test_display(three):
    none = keyword_search(three, "zzz")
    assert display_lines(none, "zzz").count() == 0
    assert no_result_message(none, "zzz").collect() == [("No results found for search query: 'zzz'",)]
    found = keyword_search(three, "relevant", True)
    assert no_result_message(found, "relevant").count() == 0 and no_result_message(found, "").count() == 1
    once = [r.line for r in display_lines(found, "relevant").orderBy("line_no").collect()]
    assert once[:4] == ["------------ Search Results ------------", "Dataset: dataset2 for search query: 'relevant'", "Score: 2", "-" * 40] and len(once) == 10
    assert [r.line for r in display_lines(found, "relevant", repeat=True).orderBy("line_no").collect()] == once * 2
    assert "  relevant: 2" in [r.line for r in display_lines(keyword_search(three, "relevant"), "relevant").collect()]


def test_parse():
    ops = {q: [(o.name, o.args) for o in parse_query(q)] for q in ("", "semantic", "semantic:", "semantic:a:b", "semantic:a, semantic:b")}
    assert ops == {"": [("", ())], "semantic": [("semantic", ())], "semantic:": [("semantic", ("",))], "semantic:a:b": [("semantic", ("a", "b"))], "semantic:a, semantic:b": [("semantic", ("a",)), (" semantic", ("b",))]}


def test_engine(three, capsys):
    engine = DiscoveryEngine(three)
    out = list(engine.run("semantic:relevant,foo:x,vector:erosion,Semantic:a,query_by_example:y,cause_and_consequences"))
    assert [r.known for r in out] == [True, False, True, False, True, True]
    said = [[m.message for m in r.messages.collect()] for r in out]
    assert said == [[], ["Unknown operation: foo"], ["Performing cause and consequences search for: 'erosion' in dataset of size: 3"], ["Unknown operation: Semantic"], ["Performing query by example search for: 'y' in dataset of size: 3"], said[5]]
    assert "semantic:relevant" in said[5][0]
    several = engine.run("vector:a,semantic,vector:b")  # what comes before an error is not lost
    assert next(several).operation.name == "vector"
    with pytest.raises(ValueError, match="argument"):
        next(several)
    engine.show("semantic:information,semantic:", True)
    assert "No results found for search query: ''" in capsys.readouterr().out


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,note\n"two\nlines ""quoted""",True\nNone,NULL\n3.5,snake_case\nnan,2020-01-01\n')
    (tmp_path / "a_metadata.json").write_text('{"title": "Rents", "description": "Housing data", "more": 1}')
    (tmp_path / "c_metadata.csv").write_text("x\n1\n")
    (tmp_path / "d.CSV").write_text("x\n1\n")
    loaded = load_folder(spark, str(tmp_path))
    assert list(loaded) == ["a"] and loaded["a"].metadata["more"] == 1
    got = Collection.of(spark, loaded.values())
    assert {r.word: r.cnt for r in content_index(got).collect()} == {"two": 1, "lines": 1, "quoted": 1, "true": 1, "snake_case": 1}
    assert ranking(got, "housing", True) == [("a", 1)]
    (tmp_path / "b.csv").write_text("x\nword\n")
    with pytest.raises(FileNotFoundError, match="Metadata file"):
        load_folder(spark, str(tmp_path))
    assert load_folder(spark, str(tmp_path), include_metadata=False)["a"].metadata is None
    with pytest.raises(FileNotFoundError, match="Dataset file"):
        load_dataset(spark, str(tmp_path), "zzz")


def test_many_files_are_one_scan(spark, tmp_path):
    """Files of one header share a scan; names, quotes, line breaks, missing values and repeated columns as in single loads."""
    for i in range(12):
        (tmp_path / f"part {i}+x.csv").write_text(f'name,name,flag\nalpha{"" if i % 2 else " beta"},"say ""gamma""",True\nNULL,,n/a\n')
    (tmp_path / "other.csv").write_text('\ufefftext\n"two\nlines"\n')
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "header.csv").write_text("name,name,flag\n")
    folder = tmp_path.as_uri()
    one = Collection.of(spark, load_folder(spark, folder, include_metadata=False).values())
    many = load_collection(spark, folder, include_metadata=False)
    counts = lambda c: sorted((r.dataset_name, r.word, r.cnt) for r in content_index(c).collect())
    assert counts(many) == counts(one) and len({n for n, _, _ in counts(many)}) == 13 and ("part 0+x", "beta", 1) in counts(many)
    assert many.catalog.orderBy("ord").collect() == one.catalog.orderBy("ord").collect()
    assert load_dataset(spark, folder, "part 0+x", False).data.columns == ["name", "name.1", "flag"]
    with pytest.raises(FileNotFoundError, match="Folder"):
        load_collection(spark, folder + "/none")


def test_saved_datasets_load_again(spark, tmp_path):
    rows = [('a "b", c', "true"), (None, "line\nbreak"), ("été", "x")]
    save_dataset(tmp_path.as_uri(), "t", spark.createDataFrame(rows, "p string, q string"), {"title": "Été", "description": "d", "more": [1]})
    got = load_dataset(spark, tmp_path.as_uri(), "t")
    assert sorted(map(str, map(tuple, got.data.collect()))) == sorted(map(str, rows)) and got.metadata == {"title": "Été", "description": "d", "more": [1]}


def test_ranks_by_slices(spark, monkeypatch):
    from tablescout.operators import search

    scored = spark.createDataFrame([(f"d{i}", i, i * 7 % 5) for i in range(60)], "dataset_name string, ord long, score long")
    want = [r.dataset_name for r in scored.orderBy(F.desc("score"), "ord").collect()]
    for size in (1 << 16, 7):
        monkeypatch.setattr(search, "SLICE", size)
        got = search.rank_datasets(scored).orderBy("rank").collect()
        assert [r.dataset_name for r in got] == want and [r["rank"] for r in got] == list(range(1, 61))


def test_dataset_is_immutable(spark):
    d = Dataset("a", spark.range(1))
    e = d.with_metadata({"title": "t"})
    assert e.id == d.id and d.metadata is None and e.metadata == {"title": "t"} and "a" in repr(d)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from(["relevant", "data", "this", "zzz", "1"]), max_size=5))
def test_scores_add_up(three, words):
    one = {w: dict(ranking(three, w)) for w in set(words)}
    assert dict(ranking(three, " ".join(words))) == {n: sum(one[w][n] for w in words) for n in ROWS}
