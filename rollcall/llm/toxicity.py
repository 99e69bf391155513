"""Toxicity: a convolutional text classifier on hashed word embeddings.

Method.  A word (lower-cased, split at white space and ASCII punctuation) is
the sum of three embeddings, hashed from the word and from its first four and
six bytes, so that unseen forms of a stem still count.  Filters of widths 1, 2
and 3 run over the words of a whole text, each keeps its maximum (max
pooling), and a logistic layer gives the score (Adam in numpy, gradients
through the maxima).  Embeddings start at zero: a word never seen in training
adds nothing.

Every labelled document counts.  A fifth of them, by a hash of the id, calibrate
the thresholds; the net is learned from all others.  Spark tasks turn their
texts into hashed ids, written once, and deal them by id into chunks of about
``FIT_ROWS`` documents and ``FIT_WORDS`` words.  In each of ``PASSES`` passes
every chunk is learned from in a task of its own, starting from the same net;
the changes are averaged (those of embeddings that few steps touched are
summed), also by Spark, and added to the net.  What comes to the driver is one
net.

The first pass starts from a net learned on the driver from at most
``FIT_ROWS`` documents and ``FIT_WORDS`` words, at most half of the documents of either label,
in ``EPOCHS`` turns over ``PARTS`` parts put together in the same way,
so that the chunks agree on what each filter looks for; those above
``FIT_DOC_WORDS`` come after all others, and one that does not fit is passed
over.  Only this start is bounded.

For scoring, each filter's response to each embedding bucket is tabulated
once, so that a position costs a few table reads.  Texts are scored whole
inside Arrow batches, a few megabytes at a time, without a shuffle.

Decision thresholds are calibrated for each language on all labelled documents
kept from the net: the one with the best F1 of toxic documents, counted for
every occupied one of ``BINS`` steps of the score.  Scores do not depend on
the language.

Defined results: null or empty texts have no words and get the net's score of
an empty text; rows that repeat are scored each, and of an id with several texts one is learned from; null ids are
kept; a language
without ``CALIBRATION_ROWS`` labelled rows of each class has threshold
``DEFAULT_THRESHOLD``; with labels of one class every score is the share of
label 1, without labels it is 0 (both within 1e-4); such a constant model has
infinite thresholds and rejects nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm.labelled import known_labels, sample
from rollcall.llm.rows import give_back_memory, small_batches, sure_small, tidy
from rollcall.llm.words import SPACES, WordHasher, slices
from rollcall.session import durable

FIT_ROWS = 12_000  # documents of a chunk, and of the start
FIT_WORDS = 3_000_000  # words of a chunk (about), and those brought to the driver at most; whole documents
FIT_DOC_WORDS = 3_000  # longer documents are taken last, so that 1,000 others always fit
PASSES = 3
PASS_RATE = 0.02  # of the first pass, then halved
TURNS = 2  # of a chunk in a pass
TOUCHES = 8  # that an embedding is moved by in a pass, if its chunks have no more each
PARTS = 4  # chunks at least: the mean of several nets is steadier than one
LABEL_BROADCAST = 1_000_000  # labels, 16 MB
CALIBRATE = 5  # one labelled document in so many sets the thresholds
BINS = 1 << 16
CALIBRATION_ROWS = 20
DEFAULT_THRESHOLD = 0.5

BUCKETS = 1 << 15
HEADS = (4, 6)  # bytes of a word's beginning with embeddings of their own
SIDES = 1 + len(HEADS)
DIM = 8
FILTERS = 6
WIDTHS = (1, 2, 3)
EPOCHS = 6
RATE = 0.02
BATCH = 32
PIECE = 1 << 16  # words whose embeddings are held at once
BLOCK = 1 << 10  # table rows whose changes are averaged together

# Fixed value: ASCII punctuation
_PUNCTUATION = tuple(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


class Net(NamedTuple):
    table: np.ndarray  # SIDES * BUCKETS x DIM
    filters: tuple[np.ndarray, ...]  # width x DIM x FILTERS each
    bias: np.ndarray
    out: np.ndarray
    shift: float


def hasher() -> WordHasher:
    return WordHasher(fold_ascii=True, separators=SPACES + _PUNCTUATION)


def word_ids(column: pa.Array, words: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """(n x SIDES table rows, first word of each text)."""
    found, heads = words.words_and_heads(column, HEADS)
    low = np.uint64(BUCKETS - 1)
    sides = [(x & low) + np.uint64(i * BUCKETS) for i, x in enumerate([found.hash, *heads])]
    return np.stack(sides, axis=1).astype(np.int32), found.first


def _responses(emb: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Response at each position to windows that begin there; zero padded at the end."""
    out = emb @ kernel[0]
    for step in range(1, len(kernel)):
        out[:-step] += emb[step:] @ kernel[step]
    return out


def fresh(share: float, seed: int = 7) -> Net:
    """A net that has seen nothing and scores every text ``share``."""
    rng = np.random.default_rng(seed)
    table = np.zeros((SIDES * BUCKETS, DIM), np.float32)
    filters = tuple(rng.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS)
    bias = np.full(len(WIDTHS) * FILTERS, 0.05, np.float32)
    return Net(table, filters, bias, np.zeros_like(bias), _log_odds(float(np.clip(share, 1e-4, 1 - 1e-4))))


class Change(NamedTuple):
    """What a net changes by in one chunk."""

    table: np.ndarray
    touches: np.ndarray  # number of steps that moved each table row
    dense: np.ndarray  # all but the table
    rows: int


def train(net: Net, texts: list[np.ndarray], y: np.ndarray, rate: float, seed: int, turns: int = 1) -> Change:
    """What ``turns`` turns over texts, given as (n x SIDES) table rows, and labels 0 and 1 change."""
    signs = np.where(np.arange(len(net.bias)) % 2, -1, 1).astype(np.float32)
    out = net.out if net.out.any() else np.float32(0.3) * signs
    parts = [p.copy() for p in (net.table, *net.filters, net.bias, out)] + [np.array([net.shift], np.float32)]
    slow, fast = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    touches = np.zeros(len(net.table), np.int32)
    rng = np.random.default_rng(seed)
    order = np.concatenate([rng.permutation(len(y)) for _ in range(turns)])
    for step, at in enumerate(range(0, len(order), BATCH), 1):
        pick = order[at : at + BATCH]
        ids = np.concatenate([texts[i] for i in pick])
        first = np.concatenate(([0], np.cumsum([len(texts[i]) for i in pick])))
        grads = _gradients(parts, ids, first, y[pick])
        touches[grads[0][0]] += 1
        for i, (p, g) in enumerate(zip(parts, grads)):
            rows = slice(None)
            if i == 0:  # only the rows of this batch move
                rows, g = g
            slow[i][rows] = 0.9 * slow[i][rows] + 0.1 * g
            fast[i][rows] = 0.99 * fast[i][rows] + 0.01 * g * g
            m, v = slow[i][rows] / (1 - 0.9**step), fast[i][rows] / (1 - 0.99**step)
            p[rows] -= rate * m / (np.sqrt(v) + 1e-6)
    got = Net(parts[0], tuple(parts[1 : 1 + len(WIDTHS)]), parts[-3], parts[-2], float(parts[-1][0]))
    return Change(got.table - net.table, touches, _dense(got) - _dense(net), len(y))


def _dense(net: Net) -> np.ndarray:
    return np.concatenate([*[f.ravel() for f in net.filters], net.bias, net.out, [net.shift]]).astype(np.float32)


def _changed(net: Net, table: np.ndarray, dense: np.ndarray) -> Net:
    """The net with changes of its embeddings and of all else added."""
    dense, filters, at = _dense(net) + dense, [], 0
    for kernel in net.filters:
        filters.append(dense[at : at + kernel.size].reshape(kernel.shape))
        at += kernel.size
    n = len(net.bias)
    return Net(net.table + table, tuple(filters), dense[at : at + n], dense[at + n : at + 2 * n], float(dense[-1]))


def _averaged(changes: list[np.ndarray], rows: list[int]) -> np.ndarray:
    """Mean of the chunks' changes by their numbers of rows."""
    total = sum(n * change.astype(float) for n, change in zip(rows, changes))
    return (total / max(sum(rows), 1)).astype(np.float32)


def _added(changes: list[np.ndarray], touches: list[np.ndarray]) -> np.ndarray:
    """Embeddings' changes: the sum of what is seldom touched, at most that of ``TOUCHES`` touches, or the mean if it is more.

    A word that is rare in each chunk is learned from all its places, and one
    that every chunk has learned alone is not moved too far.
    """
    total = sum(change.astype(float) for change in changes)
    times, chunks = sum(t.astype(float) for t in touches), sum(t > 0 for t in touches)
    share = np.clip(TOUCHES / np.maximum(times, 1), 1 / np.maximum(chunks, 1), 1)
    return (total * share[:, None]).astype(np.float32)


def _gradients(parts: list[np.ndarray], ids: np.ndarray, first: np.ndarray, y: np.ndarray) -> list:
    table, filters, bias, out, shift = parts[0], parts[1 : 1 + len(WIDTHS)], parts[-3], parts[-2], parts[-1]
    rows = len(first) - 1
    pooled = np.zeros((rows, len(bias)), np.float32)
    spots = np.full((rows, len(bias)), -1, np.int64)
    for at in range(0, len(ids), PIECE):
        to = min(at + PIECE, len(ids))
        emb = table[ids[at : to + max(WIDTHS) - 1]].sum(1)
        inside = range(np.searchsorted(first, at, "right") - 1, np.searchsorted(first, to, "left"))
        for k, kernel in enumerate(filters):
            width, cols = len(kernel), slice(k * FILTERS, (k + 1) * FILTERS)
            response = _responses(emb, kernel) + bias[cols]
            for r in inside:
                begin, end = max(first[r], at), min(first[r + 1] - width + 1, to)
                if end > begin:
                    part = response[begin - at : end - at]
                    spot = part.argmax(0)
                    value = part[spot, np.arange(FILTERS)]
                    better = value > pooled[r, cols]
                    spots[r, cols] = np.where(better, spot + begin, spots[r, cols])
                    pooled[r, cols] = np.maximum(value, pooled[r, cols])
    p = 1 / (1 + np.exp(-(pooled @ out + shift[0])))
    slope = ((p - y) / rows).astype(np.float32)
    g_out, g_shift = pooled.T @ slope, np.array([slope.sum()], np.float32)
    g_pool = np.where(spots >= 0, slope[:, None] * out[None, :], 0).astype(np.float32)
    g_bias, g_filters = g_pool.sum(0), [np.zeros_like(f) for f in filters]
    g_rows, g_values = [], []
    for k, kernel in enumerate(filters):
        r, f = np.nonzero(spots[:, k * FILTERS : (k + 1) * FILTERS] >= 0)
        spot, slope_rf = spots[r, k * FILTERS + f], g_pool[r, k * FILTERS + f]
        for j in range(len(kernel)):
            np.add.at(g_filters[k][j].T, f, slope_rf[:, None] * table[ids[spot + j]].sum(1))
            back = slope_rf[:, None] * kernel[j].T[f]
            for side in range(SIDES):
                g_rows.append(ids[spot + j, side])
                g_values.append(back)
    if g_rows:
        rows_of, spot = np.unique(np.concatenate(g_rows), return_inverse=True)
        g_table = np.zeros((len(rows_of), DIM), np.float32)
        np.add.at(g_table, spot, np.concatenate(g_values))
    else:
        rows_of, g_table = np.empty(0, np.int64), np.zeros((0, DIM), np.float32)
    return [(rows_of, g_table), *g_filters, g_bias, g_out, g_shift]


class Scorer:
    """Scores texts with each filter's response to each bucket tabulated."""

    def __init__(self, net: Net):
        self.net = net
        # the steps of all filters side by side: one read per word and table row
        self.steps = [(k, j) for k, kernel in enumerate(net.filters) for j in range(len(kernel))]
        self.table = np.concatenate([net.table @ net.filters[k][j] for k, j in self.steps], axis=1)

    def __call__(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        net, rows = self.net, len(first) - 1
        pooled = np.zeros((rows, len(net.bias)), np.float32)
        if len(ids):
            read = self.table[ids[:, 0]]
            for side in range(1, SIDES):
                read += self.table[ids[:, side]]
            for k, kernel in enumerate(net.filters):
                width, cols = len(kernel), slice(k * FILTERS, (k + 1) * FILTERS)
                at = {j: s * FILTERS for s, (kk, j) in enumerate(self.steps) if kk == k}
                response = read[:, at[0] : at[0] + FILTERS].copy()
                for j in range(1, width):
                    response[:-j] += read[j:, at[j] : at[j] + FILTERS]
                pooled[:, cols] = self._largest(response + net.bias[cols], first, width)
        margin = pooled @ net.out + net.shift
        return 1 / (1 + np.exp(-np.clip(margin.astype(np.float64), -30, 30)))

    @staticmethod
    def _largest(response: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
        """Largest response of full windows of each text, at least 0."""
        out = np.zeros((len(first) - 1, response.shape[1]), response.dtype)
        # the last width - 1 windows of a text reach into the next one
        for back in range(1, width):
            response[np.maximum(first[1:] - back, 0)] = 0
        use = np.flatnonzero(first[1:] > first[:-1])
        if len(use):
            out[use] = np.maximum(np.maximum.reduceat(response, first[:-1][use], axis=0), 0)
        return out


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = hasher()
    for batch in batches:
        for part in slices(batch, "text"):
            ids, first = word_ids(part.column(3), words)
            rows = [ids[a:b].tobytes() for a, b in zip(first, first[1:])]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1).cast(pa.int32()), part.column(2), pa.array(np.diff(first)), pa.array(rows, pa.binary())],
                ["doc_id", "label", "lang", "n", "ids"],
            )


def _fitting(rows: list[tuple[int, int, int]], most: int) -> list[tuple[int, int]]:
    """(doc_id, mark) of the rows (doc_id, mark, words) that fit into ``most`` words, long ones last."""
    out, held = [], 0
    rows = sorted(rows)
    order = np.random.default_rng(5).permutation(len(rows))
    for i in sorted(order, key=lambda i: rows[i][2] > FIT_DOC_WORDS):
        doc_id, mark, n = rows[i]
        if held + n <= most:
            out.append((doc_id, mark))
            held += n
    return out


def _collected(docs: DataFrame, known: DataFrame, most: int) -> list[tuple[int, str, bytes]]:
    """(label, lang, ids) of at most ``most`` labelled documents and ``FIT_WORDS`` words."""
    rows = sample(docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")), known, most, balanced=True)
    chosen = rows.select(F.col("doc_id").cast("bigint"), "label", F.coalesce("lang", F.lit("")).alias("lang"), "text")
    made = chosen.mapInArrow(tidy(_examples), "doc_id bigint, label int, lang string, n bigint, ids binary")
    made = durable(made.withColumn("mark", F.xxhash64("ids", "lang")), "examples")
    # an id counts once, by a text that is not long if there is one; so this has at most ``most`` rows
    first = F.min_by(F.struct("mark", "n"), F.struct(F.col("n") > FIT_DOC_WORDS, "mark")).alias("one")
    counts = made.groupBy("doc_id").agg(first).select("doc_id", "one.*").toArrow()
    fit = _fitting(list(zip(*[counts.column(c).to_pylist() for c in ("doc_id", "mark", "n")])), FIT_WORDS)
    picked = docs.sparkSession.createDataFrame(
        pa.table({"doc_id": pa.array([d for d, _ in fit], pa.int64()), "mark": pa.array([m for _, m in fit], pa.int64())})
    )
    # equal rows of an id are one
    got = made.join(F.broadcast(picked), ["doc_id", "mark"]).groupBy("doc_id")
    got = got.agg(*[F.any_value(c).alias(c) for c in ("label", "lang", "ids")]).toArrow()
    return list(zip(*[got.column(c).to_pylist() for c in ("label", "lang", "ids")]))


def _log_odds(p: float) -> float:
    return float(np.log(p / (1 - p)))


class Model(NamedTuple):
    net: Net
    thresholds: dict[str, float]
    otherwise: float = DEFAULT_THRESHOLD  # of languages without a threshold


def _calibrates() -> Column:
    return F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(CALIBRATE)) == 0


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Examples with two bytes to a table row: the side of a row is its place."""
    for batch in _examples(batches):
        ids = [(np.frombuffer(x, np.int32) & (BUCKETS - 1)).astype(np.uint16).tobytes() for x in batch.column(4).to_pylist()]
        yield batch.set_column(4, "ids", pa.array(ids, pa.binary()))


def _unpacked(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, np.uint16).reshape(-1, SIDES).astype(np.int32) + np.arange(SIDES, dtype=np.int32) * BUCKETS


def _all_examples(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, label, lang, n, ids, mark) of every labelled document, written once."""
    labelled = docs.select(F.col("doc_id").cast("bigint"), "text", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    ids = known.select(F.col("doc_id").cast("bigint"), "label")
    rows = labelled.join(F.broadcast(ids) if sure_small(ids, LABEL_BROADCAST) else ids, "doc_id")
    made = rows.select("doc_id", "label", "lang", "text").mapInArrow(
        tidy(_packed), "doc_id bigint, label int, lang string, n bigint, ids binary"
    )
    return durable(made.withColumn("mark", F.xxhash64("ids", "lang")), "examples")


def _one_text_each(rows: pa.Table) -> pa.Table:
    """The rows by id, one for each: a text that is not long if there is one."""
    ids, mark = rows.column("doc_id").to_numpy(), rows.column("mark").to_numpy()
    order = np.lexsort((mark, rows.column("n").to_numpy() > FIT_DOC_WORDS, ids))
    ids = ids[order]
    return rows.take(pa.array(order[np.concatenate(([True], ids[1:] != ids[:-1]))]))


def _pass(examples: DataFrame, net: Net, chunks: int, turn: int) -> Net:
    """The net after one pass over all examples: the changes of all chunks, put together."""
    spark = examples.sparkSession
    held = spark.sparkContext.broadcast(tuple(net))

    def learn(rows: pa.Table) -> pa.Table:
        start, chunk = Net(*held.value), rows.column("chunk")[0].as_py()
        rows = _one_text_each(rows)
        texts = [_unpacked(x) for x in rows.column("ids").to_pylist()]
        y = rows.column("label").to_numpy().astype(float)
        got = train(start, texts, y, PASS_RATE / 2**turn, seed=turn, turns=TURNS)
        blocks = np.flatnonzero(got.touches.reshape(-1, BLOCK).any(1))
        at = [slice(b * BLOCK, (b + 1) * BLOCK) for b in blocks]
        out = pa.table(
            {
                "block": pa.array([-1, *blocks.tolist()], pa.int32()),
                "chunk": pa.array([chunk] * (1 + len(at)), pa.int64()),
                "rows": pa.array([got.rows] * (1 + len(at)), pa.int64()),
                "touches": pa.array([b"", *[got.touches[x].tobytes() for x in at]], pa.binary()),
                "delta": pa.array([got.dense.tobytes(), *[got.table[x].tobytes() for x in at]], pa.binary()),
            }
        )
        give_back_memory()
        return out

    def gather(found: pa.Table) -> pa.Table:
        found, block = found.sort_by("chunk"), found.column("block")[0].as_py()
        changes = [np.frombuffer(x, np.float32) for x in found.column("delta").to_pylist()]
        if block < 0:
            made = _averaged(changes, found.column("rows").to_pylist())
        else:
            touches = [np.frombuffer(x, np.int32) for x in found.column("touches").to_pylist()]
            made = _added([x.reshape(BLOCK, DIM) for x in changes], touches)
        return pa.table({"block": pa.array([block], pa.int32()), "delta": pa.array([made.tobytes()], pa.binary())})

    dealt = examples.withColumn("chunk", F.pmod(F.xxhash64(F.lit("chunk"), "doc_id"), F.lit(chunks).cast("bigint")))
    moves = dealt.groupBy("chunk").applyInArrow(learn, "block int, chunk bigint, rows bigint, touches binary, delta binary")
    made = moves.groupBy("block").applyInArrow(gather, "block int, delta binary").toArrow()
    held.destroy()
    table, dense = np.zeros_like(net.table), np.zeros_like(_dense(net))
    for block, delta in zip(made.column("block").to_pylist(), made.column("delta").to_pylist()):
        if block < 0:
            dense = np.frombuffer(delta, np.float32)
        else:
            table[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(delta, np.float32).reshape(BLOCK, DIM)
    return _changed(net, table, dense)


def _log_odds(p: float) -> float:
    return float(np.log(p / (1 - p)))


class Model(NamedTuple):
    net: Net
    thresholds: dict[str, float]
    otherwise: float = DEFAULT_THRESHOLD  # of languages without a threshold


def _start(docs: DataFrame, known: DataFrame, most: int, share: float) -> Net:
    """A net learned on the driver from at most ``most`` documents, its odds of label 1 set to those of ``share``."""
    rows = sorted(_collected(docs, known, most))
    order = np.random.default_rng(3).permutation(len(rows))  # task order must not change the fit
    texts = [np.frombuffer(rows[i][2], np.int32).reshape(-1, SIDES) for i in order]
    y = np.array([rows[i][0] for i in order], float)
    if len(set(y)) < 2:
        return fresh(share)
    net = fresh(y.mean())
    parts = [slice(i, None, PARTS) for i in range(min(PARTS, len(y)))]
    for turn in range(EPOCHS):
        got = [train(net, texts[part], y[part], RATE, seed=turn) for part in parts]
        table = _added([x.table for x in got], [x.touches for x in got])
        net = _changed(net, table, _averaged([x.dense for x in got], [x.rows for x in got]))
    return net._replace(shift=net.shift + _log_odds(share) - _log_odds(y.mean()))


def fit_toxicity(docs: DataFrame, labels: DataFrame, usable: Column, most: int = FIT_ROWS, label: str = "toxic") -> Model:
    """Net and thresholds from all labelled documents for which ``usable`` (over labels) holds.

    ``most`` is the number of documents of a chunk.  About every fifth
    document calibrates the thresholds, the others train the net.
    """
    small_batches(docs.sparkSession)
    known = known_labels(labels, label, usable)
    examples = _all_examples(docs, known)
    fit, calibration = examples.where(~_calibrates()), examples.where(_calibrates())
    size = fit.agg(F.count("*").alias("rows"), F.sum("n").alias("words"), F.avg("label").alias("share")).first()
    share = size["share"] or 0.0
    if not 0 < share < 1:  # a constant tells nothing apart
        return Model(fresh(share), {}, float("inf"))
    net = _start(docs, known.where(~_calibrates()), most, share)
    chunks = max(PARTS, -(-size["rows"] // most), -(-size["words"] // FIT_WORDS))
    for turn in range(PASSES):
        net = _pass(fit, net, chunks, turn)
    return Model(net, _thresholds(calibration, net))


def _thresholds(examples: DataFrame, net: Net) -> dict[str, float]:
    """The threshold of best F1 of each language, over all ``examples``."""
    held = examples.sparkSession.sparkContext.broadcast(tuple(net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Net(*held.value))
        for batch in batches:
            texts = (_unpacked(x) for x in batch.column(0).to_pylist())
            score = [scorer(t, np.array([0, len(t)]))[0] for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score, pa.float64())], [*batch.schema.names[1:], "score"])

    rows = examples.select("ids", "doc_id", "label", "lang", "n", "mark")
    scored = rows.mapInArrow(tidy(run), "doc_id bigint, label int, lang string, n bigint, mark bigint, score double")
    # an id counts once, as in learning
    first = F.min_by(F.struct("label", "lang", "score"), F.struct(F.col("n") > FIT_DOC_WORDS, "mark")).alias("one")
    one = scored.groupBy("doc_id").agg(first).select("one.*")
    step = F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).alias("step")
    bins = one.groupBy("lang", step).agg(F.sum("label").alias("hits"), F.count("*").alias("rows"))
    down = Window.partitionBy("lang").orderBy(F.col("step").desc())  # at most BINS rows of a language
    upto, whole = down.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("lang")
    hits, count = F.sum("hits").over(whole), F.sum("rows").over(whole)
    judged = bins.select(
        "lang",
        "step",
        (2 * F.sum("hits").over(upto) / (F.sum("rows").over(upto) + hits)).alias("f1"),
        (F.lead("step").over(down) + 1).alias("below"),
        hits.alias("ones"),
        (count - hits).alias("zeros"),
    )
    enough = judged.where(F.least("ones", "zeros") >= CALIBRATION_ROWS)
    best = enough.groupBy("lang").agg(F.max_by(F.struct("step", "below"), F.struct("f1", "step")).alias("at")).select("lang", "at.*")
    # half-way to the next lower score
    out = {r["lang"]: (r["step"] + (r["below"] or 0)) / 2 / BINS for r in best.collect()}
    held.destroy()
    return dict(sorted(out.items()))


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text, lang) as doc_id, lang, score, threshold, toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, scorer = hasher(), Scorer(Net(*net.value))
        for batch in batches:
            for part in slices(batch, "text"):
                score = scorer(*word_ids(part.column(2), words))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(score)], ["doc_id", "lang", "score"]
                )

    small_batches(docs.sparkSession)
    net = docs.sparkSession.sparkContext.broadcast(tuple(model.net))
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("lang").cast("string"), "text")
    scored = rows.mapInArrow(tidy(run), "doc_id bigint, lang string, score double")
    threshold = _threshold(model, F.col("lang"))
    return scored.withColumn("threshold", threshold).withColumn("toxic", F.col("score") >= F.col("threshold"))


def _threshold(model: Model, lang: Column) -> Column:
    out = F.lit(model.otherwise)
    for name, value in model.thresholds.items():
        out = F.when(F.coalesce(lang, F.lit("")) == name, value).otherwise(out)
    return out


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the documents that reach their language's threshold; all columns kept."""
    small_batches(docs.sparkSession)
    net = docs.sparkSession.sparkContext.broadcast(tuple(model.net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, scorer = hasher(), Scorer(Net(*net.value))
        for batch in batches:
            text = batch.schema.get_field_index("text")
            for part in slices(batch, "text"):
                score = scorer(*word_ids(part.column(text), words))
                keep = score < part.column(part.num_columns - 1).to_numpy()
                yield part.filter(pa.array(keep)).select(list(range(part.num_columns - 1)))

    limited = docs.withColumn("__llm_threshold", _threshold(model, F.col("lang").cast("string")))
    return limited.mapInArrow(tidy(run), docs.schema)
