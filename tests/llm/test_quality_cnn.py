"""The network learns what separates the classes and scores each text on its own."""

import zlib

import numpy as np

from strandlake.llm import quality_cnn as q


def test_score_does_not_depend_on_neighbours_or_blocks():
    net = q.Network()
    texts = [b"", b"a b b c", b"the cat " * 300, "é".encode() * 513, b"x" * 5000, b"end"]
    together = net.score(texts)
    alone = np.array([net.score([t])[0] for t in texts])
    assert (together == alone).all()
    assert (net.score(texts[::-1])[::-1] == together).all()


def test_pooling_covers_the_whole_text():
    """Brute force over every window of one text."""
    net = q.Network()
    text = bytes(np.random.default_rng(1).integers(33, 120, 1500, dtype=np.uint8))
    symbols, offsets = q.symbols_of([text])
    end = offsets[1]
    response = np.array([sum(net.p["tables"][t, symbols[i + t]] for t in range(q.TAPS)) for i in range(0, end - 5, q.STRIDE)])
    chunks = [np.maximum(response[i // 2 : (i + q.CHUNK) // 2].max(0) + net.p["bias"], 0) for i in range(0, end - q.HALF, q.HALF)]
    logit = np.max(chunks, 0) @ net.p["most"] + np.mean(chunks, 0) @ net.p["mean"] + net.p["base"][0]
    assert np.isclose(net.score([text])[0], 1 / (1 + np.exp(-logit)), atol=1e-5)


def test_symbols_are_the_bytes():
    symbols, offsets = q.symbols_of([b"ab ab", "\xe9".encode()])
    assert list(symbols[:6]) == [97, 98, 32, 97, 98, 0] and list(symbols[offsets[1] : offsets[1] + 3]) == [195, 169, 0]
    assert list(np.diff(offsets)) == [2 * q.HALF] * 2 and symbols.size == offsets[-1] + q.CHUNK


def test_gradients_equal_differences(monkeypatch):
    """Of the log loss, by small steps of single parameters; texts of one and of many chunks."""
    net, draw = q.Network(), np.random.default_rng(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    monkeypatch.setattr(np, "float32", np.float64)  # differences need more digits
    texts = [bytes(draw.integers(97, 123, n, dtype=np.uint8)) for n in (5, 300, 2000)]
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        found, _, starts = net.pooled(*q.symbols_of(texts))
        z = net.logits(found, starts)[0]
        return float((weight * (np.log1p(np.exp(z)) - y * z)).mean())

    grads, step = net.gradients(texts, y, weight), 1e-6
    for name in net.p:
        flat, found = net.p[name].ravel(), np.ravel(grads[name])
        at = np.argsort(-np.abs(found))[:5]
        for i in at:
            kept = flat[i]
            flat[i] = kept + step
            up = loss()
            flat[i] = kept - step
            down = loss()
            flat[i] = kept
            assert np.isclose((up - down) / (2 * step), found[i], rtol=1e-3, atol=1e-4), (name, i)


def test_blocks_of_one_long_text_agree(monkeypatch):
    net, text = q.Network(), bytes(np.random.default_rng(2).integers(33, 120, 30_000, dtype=np.uint8))
    whole = net.score([text, b"x"])
    monkeypatch.setattr(q, "BLOCK", 7)
    assert (net.score([text, b"x"]) == whole).all()


def test_repeated_rows_and_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = q.score_documents(docs, none).collect()
    assert len(rows) == 3 and {r.score for r in rows} == {0.5}


def test_learns_and_keeps_columns(spark):
    good = ["the river ran along the old wall %d" % i for i in range(80)]
    bad = ["BUY!! NOW!! CHEAP!! %d" % i for i in range(80)]
    rows = [(i, t, "x", 1.0) for i, t in enumerate(good + bad)] + [(900, None, "x", None), (901, "", None, 2.0), (902, bad[0] * 900, "x", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score double").repartition(3)
    labels = spark.createDataFrame([(i, int(i < 80), None) for i in range(160)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in q.score_documents(docs, labels).collect()}
    assert len(out) == 163
    held = [r for i, r in out.items() if i < 160 and r.held_out]
    assert held and all(r.predicted == (r.doc_id < 80) for r in held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out.values())
    assert out[902].predicted == 0 and 0 <= out[900].score <= 1 and out[900].score == out[901].score
    kept = q.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.where("doc_id < 160").collect()} >= {r.doc_id for r in held if r.predicted}
    assert q.score_documents(docs.limit(0), labels).count() == 0


def test_one_class_only(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert all(0 < r.score < 1 for r in q.score_documents(docs, labels).collect())
