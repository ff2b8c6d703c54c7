"""What must not grow faster than the input: tasks' shares, pairs that are shuffled, cells that are cut."""

from collections import Counter

from pyspark.sql import functions as F

from tablescout.operators import search, words
from tablescout.operators.collection import CATALOG, Collection, Dataset
from tablescout.operators.words import content_index, metadata_counts
from tablescout.sources import files
from tablescout.sources.files import load_collection, load_dataset, load_folder, save_dataset
from tablescout.sources.tables import load_tables


def test_large_datasets_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    rows = [(f'say "w{chr(97 + i % 26)}x",\nnext' if i % 3 else f"plain{chr(97 + i % 26)}", "True" if i % 2 else None) for i in range(200)]
    data = spark.createDataFrame(rows, "p string, q string").repartition(5)
    (tmp_path / "a.csv").write_text("p\nalpha\n")
    (tmp_path / "none.csv").mkdir()  # no files, no dataset
    folder = tmp_path.as_uri()
    monkeypatch.setattr(files, "ONE_FILE", 10)
    save_dataset(folder, "t 1+", data, {"title": "T"})
    assert len(list((tmp_path / "t 1+.csv").glob("part-*.csv"))) == 5
    assert sorted(map(str, map(tuple, load_dataset(spark, folder, "t 1+").data.collect()))) == sorted(map(str, rows))
    many = load_collection(spark, folder, include_metadata=False)
    one = load_folder(spark, folder, include_metadata=False)
    assert list(one) == ["a", "t 1+"] == [r.dataset_name for r in many.catalog.orderBy("ord").collect()] and one["t 1+"].data.columns == ["p", "q"]
    counts = lambda c: {(r.dataset_name, r.word): r.cnt for r in content_index(c).collect()}
    got = counts(many)
    assert got == counts(Collection.of(spark, one.values())) and got["t 1+", "true"] == 100 and got["t 1+", "next"] == 133 and got["a", "alpha"] == 1
    monkeypatch.setattr(files, "ONE_FILE", 1 << 20)
    save_dataset(folder, "t 1+", data.limit(2))  # in place of the folder
    assert (tmp_path / "t 1+.csv").is_file() and load_dataset(spark, folder, "t 1+", False).data.count() == 2


def test_metadata_words_are_summed_by_tasks(spark, monkeypatch):
    """Names of one row, of several and none; only the last two make pairs of word and dataset."""
    given = [("a", "x y", "x X-x"), ("b", "y", None), ("b", None, "y z"), (None, "z", "z"), (None, "q", ""), ("c", "", " "), ("d", "nan 1", "été_ 1")]
    catalog = spark.createDataFrame([(n, i, True, t, d, None) for i, (n, t, d) in enumerate(given)] + [("e", 9, False, "x", "x", None)], CATALOG)
    cnt, names = Counter(), {}
    for n, t, d in given:
        for w in (t or "").lower().replace("-", " ").split() + (d or "").lower().replace("-", " ").split():
            cnt[w] += 1
            names.setdefault(w, set()).update({n} - {None})
    paired = []
    real = words.count_words
    monkeypatch.setattr(words, "count_words", lambda w: (paired.extend(r.dataset_name for r in w.collect()), real(w))[1])
    got = metadata_counts(catalog)
    assert {r.word: (r.cnt, r.n_datasets) for r in got.collect()} == {w: (c, len(names[w])) for w, c in cnt.items()}
    assert set(paired) == {"b", None} and [t for _, t in got.dtypes] == ["string", "bigint", "bigint"]


def test_cells_without_the_words_are_not_cut(spark, monkeypatch):
    c = Collection.of(spark, [Dataset("a", spark.createDataFrame([("Alpha, THE beta",), ("R",), ("other",), ("bathes",)], "c string")), Dataset("b", spark.createDataFrame([("of 1",), ("R",)], "c string"))])
    cut = []
    real = search.content_tokens
    monkeypatch.setattr(search, "content_tokens", lambda cells: (cut.append(cells.count()), real(cells))[1])
    want = {"the alpha": {"a": 2, "b": 0}, "of 1": {"a": 0, "b": 0}, "": {"a": 0, "b": 0}}
    for query, scores in want.items():
        for most in (16, 0):
            monkeypatch.setattr(search, "SOUGHT", most)
            found = {r.dataset_name: r.score for r in search.keyword_search(c, query, top=False).collect()}
            assert found == scores, (query, most)
    assert cut == [3, 6, 0, 0, 0, 0]


def test_names_of_tables_by_path(spark, tmp_path):
    """Of files and of folders, with signs that paths encode."""
    for name in ("a b+%41.parquet", "x.parquet", "é.parquet"):
        spark.createDataFrame([("alpha",)], "a string").coalesce(1).write.parquet(f"{tmp_path}/{name}")
    next((tmp_path / "x.parquet").glob("part-*")).rename(tmp_path / "file 2%.parquet")
    got = load_tables(spark, str(tmp_path)).cells
    assert sorted(r.dataset_name for r in got.collect()) == ["a b+%41", "file 2%", "é"]
