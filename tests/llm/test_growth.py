"""What Python workers keep between tasks."""

import gc

import numpy as np
import pyarrow as pa

from tablescout.llm import bpe, ngrams


def test_workers_keep_no_encoder(spark):
    """Spark uses a worker again for other stages; an encoder's tables would stay in each."""
    docs = spark.createDataFrame([(i, f"word{i} text") for i in range(40)], "doc_id long, text string").repartition(8)
    assert bpe.encode(docs).count() == 40

    def left(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(type(x).__name__ == "TreeBPE" for x in gc.get_objects())] * b.num_rows, pa.int64())], ["n"])

    assert {r.n for r in docs.select("doc_id").mapInArrow(left, "n long").collect()} == {0}


def test_tokens_alike_tune_once():
    """Expected choices of each kind of token, times its number, are those of all tokens."""
    r = np.random.default_rng(3)
    n = r.integers(1, 9, 400)
    size = int(n.sum())
    counts = [r.integers(0, top, size).astype(np.uint32) for top in (40, 4, 2)]
    contexts = ngrams._contexts(counts, n, 7)
    a, b, (times,) = ngrams._alike(counts, n, 7)
    assert times.sum() == size and len(times) < size and all(len(x) == len(times) for x in (*a, *b))
    shares = ngrams.first_shares(3)
    for want, got in zip(ngrams.expected(shares, counts, contexts, 999, 50), ngrams.expected(shares, a, b, 999, 50, times), strict=True):
        np.testing.assert_allclose(got, want, rtol=1e-12)
    none = ngrams._alike([x[:0] for x in counts], n[:0], 7)
    assert [len(x) for columns in none for x in columns] == [0] * 6


def test_kinds_of_pieces_are_encoded_together():
    """Each kind of piece goes to the library once, many in one string; ids are the library's."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(bpe.default_path())
    tree = bpe.TreeBPE(bpe.default_path())
    words = [chr(c) + x for c in range(0xA1, 0x180) for x in ("", "Bé", "É,", "ß.", "×", "÷;", "'s", ",,")]
    words += ["a<|endoftext|>b", "<|endof", "text|>", "<|startoftext|>", "́e", "é", "ΑΣ", "İ,", "ﬁ", "　", "x y", "é" * 300, "E" * 600, ",", "é,", "Ã"]
    texts = [" ".join(words), "", " \n", " ".join(reversed(words)), *words]
    calls = []

    class Counted:
        def __init__(self, of):
            self.of = of

        def __getattr__(self, name):
            return getattr(self.of, name)

        def encode_batch_fast(self, strings, **more):
            calls.append(len(strings))
            return self.of.encode_batch_fast(strings, **more)

    tree.words, tree.tokenizer = Counted(tree.words), Counted(tree.tokenizer)
    for t, (n, ids, decoded) in zip(texts, tree.encode_many(texts), strict=True):
        want = whole.encode(t, add_special_tokens=False).ids
        assert (n, ids, decoded) == (len(want), " ".join(map(str, want)), whole.decode(want, skip_special_tokens=False)), t
    assert sum(calls) < len(words) / 20


def test_rounds_of_tuning_have_a_task_a_core(spark):
    """However many blocks there are; the shares are those of all their tokens."""
    r = np.random.default_rng(4)
    blobs = []
    for _ in range(40):
        n = r.integers(1, 9, 30)
        counts = [r.integers(0, top, int(n.sum())).astype(np.uint32) for top in (40, 4, 2)]
        blobs.append((bytearray(ngrams.pack([[ngrams._planes(x) for x in columns] for columns in ngrams._alike(counts, n, 7)], 3)),))
    table = spark.createDataFrame(blobs, "tuning binary").repartition(40)
    context, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    context.setJobGroup("tuning", "rounds")
    try:
        got = ngrams.learn_shares(table, 3, 999, 50, rounds=1)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("tuning") for s in tracker.getJobInfo(j).stageIds]
    assert sum(s.numTasks for s in stages if s and s.numTasks >= 40) <= 40  # dealing them out, no round
    shares = ngrams.first_shares(3)
    parts = [ngrams.expected(shares, *([ngrams._unplaned(x) for x in columns] for columns in ngrams.unpack(bytes(b))[:2]), 999, 50, ngrams._unplaned(ngrams.unpack(bytes(b))[2][0])) for (b,) in blobs]
    np.testing.assert_allclose(got, ngrams.new_shares(shares, sum(x for x, _ in parts), sum(x for _, x in parts)), rtol=1e-9)
