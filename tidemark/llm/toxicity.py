"""Toxicity: a convolutional text classifier over hashed word embeddings.

Words hash into ``BUCKETS`` embeddings; filters of several widths slide over the word sequence, the largest
response of each filter over the whole text is kept, and a logistic layer turns these into a score. It is
trained here, in numpy and in one task, on a bounded sample of labelled rows; scoring reads every word of every document, and the
thresholds come from the scores of all labelled rows that it was not fitted on.

A filter's response is a sum of one table lookup per word of its window (embedding times filter column,
multiplied once per model), so scoring costs six lookups a word and no matrix product.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_of
from tidemark.plans.workspace import settle

BUCKETS = 1 << 17
PAD = BUCKETS
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 12
BATCH = 128
RATE = 0.01
DECAY = 1e-4
SEED = 7
# Bounds of the training sample: labelled rows, taken in hash order of their ids, and the words of one text
# beyond which it is left out of training (never of scoring).
TRAIN_ROWS = 12_000
TRAIN_WORDS = 20_000
# The network is fitted without the last of so many parts of the sample.
PARTS = 5
# Scores that set thresholds are counted in steps of this much log odds.
STEP = 0.01
# A language with fewer labelled rows of either class than this uses the threshold of all languages.
LEAST_LABELLED = 20
_PUNCTUATION = ".,;:!?\"'()[]{}<>|*#$%&-_"


def bucket(word: str) -> int:
    return zlib.crc32(word.strip(_PUNCTUATION).encode()) % BUCKETS


class Buckets(dict):
    """Bucket of each word seen, forgotten when it grows large."""

    def __missing__(self, word):
        if len(self) > 100_000:
            self.clear()
        self[word] = found = bucket(word)
        return found

    def of(self, text: str) -> np.ndarray:
        words = text.lower().split()
        return np.fromiter(map(self.__getitem__, words), dtype=np.int32, count=len(words))


@dataclass
class Model:
    embed: np.ndarray
    filters: list  # one (width, DIM, FILTERS) array per width
    bias: np.ndarray
    weight: np.ndarray
    offset: float
    thresholds: dict = field(default_factory=dict)  # by language; None is the one for all others

    def tables(self, ids=None):
        rows = self.embed if ids is None else self.embed[ids]
        return [[rows @ f[i] for i in range(len(f))] for f in self.filters]

    def logit(self, pooled):
        return np.maximum(pooled + self.bias, 0) @ self.weight + self.offset


def _joined(texts):
    """Word ids of several texts, each with two empty words behind it (an empty text is one empty word)."""
    parts, starts, at = [], [], 0
    gap = np.full(max(WIDTHS) - 1, PAD, dtype=np.int32)
    for ids in texts:
        ids = ids if len(ids) else np.array([PAD], dtype=np.int32)
        starts.append(at)
        parts += [ids, gap]
        at += len(ids) + len(gap)
    return np.concatenate(parts), np.array(starts)


def _responses(tables, ids, count):
    """Each filter's response at each word, all widths side by side."""
    found = []
    for table in tables:
        out = table[0][ids[:count]]
        for i in range(1, len(table)):
            out = out + table[i][ids[i : count + i]]
        found.append(out)
    return np.concatenate(found, axis=1)


def scores(model: Model, tables, texts):
    """The score of each text's word ids."""
    ids, starts = _joined(texts)
    count = len(ids) - (max(WIDTHS) - 1)
    responses = _responses(tables, ids, count)
    # Windows that begin in the gap behind a text are no windows of it.
    responses[ids[:count] == PAD] = 0 if len(texts) == 1 and count == 1 else -np.inf
    pooled = np.maximum.reduceat(responses, starts, axis=0)
    pooled[~np.isfinite(pooled)] = 0
    return 1 / (1 + np.exp(-np.clip(model.logit(pooled.astype(np.float64)), -30, 30)))


def train(texts, labels, seed=SEED, epochs=EPOCHS) -> Model:
    """Fit by Adam on the logistic loss, classes weighted evenly; the gradient of a filter flows through the
    window with its largest response."""
    random = np.random.default_rng(seed)
    embed = np.zeros((BUCKETS + 1, DIM), np.float32)
    embed[:BUCKETS] = random.normal(0, 0.02, (BUCKETS, DIM))
    filters = [random.normal(0, 0.4, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    total = FILTERS * len(WIDTHS)
    model = Model(embed, filters, np.zeros(total, np.float32), random.normal(0, 0.3, total).astype(np.float32), 0.0)
    labels = np.asarray(labels, dtype=np.float64)
    positive = labels.sum()
    if not 0 < positive < len(labels):
        model.weight[:], model.offset = 0, 30.0 if positive else -30.0
        return model
    weights = np.where(labels == 1, len(labels) / (2 * positive), len(labels) / (2 * (len(labels) - positive)))
    offset = np.zeros(1)
    params = [model.embed, *model.filters, model.bias, model.weight, offset]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = random.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            ids, starts = _joined([texts[i] for i in chosen])
            used, local = np.unique(ids, return_inverse=True)
            local = local.astype(np.int32)
            count = len(ids) - (max(WIDTHS) - 1)
            responses = _responses(model.tables(used), local, count)
            lengths = np.array([max(1, len(texts[i])) for i in chosen])
            best = np.stack([s + responses[s : s + n].argmax(axis=0) for s, n in zip(starts, lengths, strict=True)])
            pooled = np.take_along_axis(responses, best, axis=0)
            hidden = np.maximum(pooled + model.bias, 0)
            logits = hidden @ model.weight + offset[0]
            error = ((1 / (1 + np.exp(-np.clip(logits, -30, 30))) - labels[chosen]) * weights[chosen] / len(chosen)).astype(np.float32)
            grads = [np.zeros_like(p) for p in params[1:]]
            grads[-1][0], grads[-2][:] = error.sum(), hidden.T @ error
            back = np.outer(error, model.weight) * (hidden > 0)
            grads[-3][:] = back.sum(axis=0)
            to_embed = np.zeros((len(used), DIM), np.float32)
            for k, width in enumerate(WIDTHS):
                mine = slice(k * FILTERS, (k + 1) * FILTERS)
                g = back[:, mine]
                for i in range(width):
                    word = local[best[:, mine] + i]
                    rows = model.embed[used[word]]
                    grads[k][i] = np.einsum("bf,bfd->df", g, rows)
                    np.add.at(to_embed, word.ravel(), (g[:, :, None] * model.filters[k][i].T[None]).reshape(-1, DIM))
            step += 1
            scale = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            live = used[used != PAD]
            for n, p in enumerate(params):
                at_rows = live if n == 0 else slice(None)
                g = to_embed[used != PAD] if n == 0 else grads[n - 1]
                if n < len(params) - 3:
                    g = g + DECAY * p[at_rows]
                first[n][at_rows] = 0.9 * first[n][at_rows] + 0.1 * g
                second[n][at_rows] = 0.999 * second[n][at_rows] + 0.001 * g * g
                p[at_rows] -= (scale * first[n][at_rows] / (np.sqrt(second[n][at_rows]) + 1e-8)).astype(p.dtype)
    model.offset = float(offset[0])
    return model


def best_threshold(found, labels, counts=None) -> float:
    """The threshold with the best F-score, precision counting twice; halfway to the next lower score.
    ``counts``: how many rows have each score and label, 1 by default."""
    order = np.argsort(-found, kind="stable")
    n = np.ones(len(found)) if counts is None else counts[order]
    s, hit = found[order], labels[order] * n
    true = np.cumsum(hit)
    precision, recall = true / np.cumsum(n), true / max(1, hit.sum())
    quality = 1.25 * precision * recall / np.maximum(0.25 * precision + recall, 1e-12)
    quality[:-1][s[:-1] == s[1:]] = -1
    at = int(quality.argmax())
    return float((s[at] + (s[at + 1] if at + 1 < len(s) else 0)) / 2)


def calibrate(model: Model, found, labels, langs, counts=None) -> None:
    """Recentre scores so that the best threshold of all languages is 0.5, and set each language's own."""
    n = np.ones(len(found)) if counts is None else counts
    if len(found) == 0 or not 0 < labels.sum() < len(labels):
        model.thresholds = {None: 0.5}
        return
    odds = lambda p: float(np.log(np.clip(p, 1e-9, 1 - 1e-9) / (1 - np.clip(p, 1e-9, 1 - 1e-9))))
    shift = odds(best_threshold(found, labels, n))
    model.offset -= shift
    moved = 1 / (1 + np.exp(-(np.log(np.clip(found, 1e-12, 1) / np.clip(1 - found, 1e-12, 1)) - shift)))
    model.thresholds = {None: 0.5}
    for lang in sorted({x for x in langs if x is not None}):
        mine = langs == lang
        if min((n * labels)[mine].sum(), (n * (1 - labels))[mine].sum()) >= LEAST_LABELLED:
            model.thresholds[lang] = float(np.clip(best_threshold(moved[mine], labels[mine], n[mine]), 0.2, 0.8))


def fold(doc_id="doc_id"):
    """crc32 of the id as text, mod 5; rows in fold 0 (and rows without an id) are never learned from."""
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 5, F.lit(0))


# The order of the training sample, which its rows carry, and what a fitted network is besides its embeddings.
_ORDER = ("id_hash", "id", "ids_hash")
_REST = "filters array<binary>, bias array<float>, weight array<float>, offset double"


def _fitted(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The network fitted on a sample without the part that ``key`` names, and the log odds, in steps, that it gives to
    each row of this part. The texts are read where they lie in the table."""
    order = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in _ORDER]).to_numpy()
    words, label = table["ids"].combine_chunks(), table["label"].to_numpy()[order].astype(float)
    texts = [np.frombuffer(words[int(i)].as_buffer(), dtype=np.int32) for i in order]
    left_out = key[0].as_py()
    held = np.arange(len(texts)) % PARTS == left_out
    model = train([t for t, h in zip(texts, held, strict=True) if not h], label[~held])
    tables = model.tables()
    found = np.array([scores(model, tables, [t])[0] for t, h in zip(texts, held, strict=True) if h])
    row = {
        "without": left_out, "steps": np.round(np.log(found / (1 - found)) / STEP), "embed": model.embed.tobytes(),
        "filters": [f.tobytes() for f in model.filters], "bias": model.bias, "weight": model.weight, "offset": model.offset,
    }
    types = pa.int32(), pa.list_(pa.float64()), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.float32()), pa.list_(pa.float32()), pa.float64()
    return pa.table([pa.array([v], type=t) for v, t in zip(row.values(), types, strict=True)], names=list(row))


def _unpacked(row: dict) -> Model:
    floats = lambda data, *shape: np.frombuffer(data, dtype=np.float32).reshape(shape)
    filters = [floats(data, width, DIM, FILTERS) for data, width in zip(row["filters"], WIDTHS, strict=True)]
    narrow = [np.array(row[k], dtype=np.float32) for k in ("bias", "weight")]
    return Model(floats(row["embed"], BUCKETS + 1, DIM), filters, *narrow, row["offset"])


def fit(docs: DataFrame, labels: DataFrame, doc_id="doc_id", text="text", lang="lang", label="toxic", train_rows=TRAIN_ROWS) -> Model:
    """Train on at most ``train_rows`` labelled rows outside fold 0, four fifths of which fit the network. All
    other labelled rows outside fold 0 set the thresholds. If a language has enough labelled rows for its own
    only with the fitted ones, these count too, each fifth as scored by a network fitted without it. Rows
    without a label are left out; of repeated labels the higher counts."""
    every = labels.filter(F.col(label).isNotNull() & (fold(doc_id) != 0))
    every = settle(every.groupBy(F.col(f"`{doc_id}`").alias("id")).agg(F.max(label).cast("int").alias("label")), "labels")
    # train_rows rows at most, so this side is small enough to broadcast.
    known = settle(every.orderBy(F.xxhash64("id"), "id").limit(train_rows), "labelled")
    text_key = F.xxhash64("text").alias("key")
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{lang}`").alias("lang"), text_of(f"`{text}`").alias("text"))

    @F.arrow_udf("binary")
    def ids_of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        buckets = Buckets()
        for part in parts:
            yield pa.array([ids.tobytes() if len(ids := buckets.of(t.as_py())) <= TRAIN_WORDS else None for t in part], pa.binary())

    # Filtered after it is written, so that the words are hashed once.
    read = settle(rows.join(F.broadcast(known), "id").select("id", "lang", "label", text_key, ids_of("text").alias("ids")), "sample")
    hashes = F.xxhash64("id").alias("id_hash"), F.xxhash64("ids").alias("ids_hash")
    sample = settle(read.filter("ids IS NOT NULL").select("*", *hashes).orderBy(*_ORDER).limit(train_rows), "training")
    # The words stay where they lie: networks are fitted in tasks, and only what a row is comes to the driver.
    known_rows = sample.select(*_ORDER, "lang", "label", "key").orderBy(*_ORDER).toArrow()
    truth = known_rows["label"].to_numpy().astype(float)
    langs = np.array(known_rows["lang"].to_pylist(), dtype=object)
    part, steps = np.arange(len(truth)) % PARTS, np.zeros(len(truth))

    def without(*parts):
        """The network fitted without each of ``parts``, which it scores; that of the last one is returned."""
        each = sample.withColumn("without", F.explode(F.array(*[F.lit(k) for k in parts])))
        found = each.groupBy("without").applyInArrow(_fitted, f"without int, steps array<double>, embed binary, {_REST}")
        if parts[-1] != PARTS - 1:
            found = found.drop("embed")
        model = None
        for row in found.toArrow().to_pylist():
            steps[part == row["without"]] = row["steps"]
            if row["without"] == PARTS - 1:
                model = _unpacked(row)
        return model

    model = without(PARTS - 1) or train([], [])
    # The rest are scored where they lie and counted per language; only counts come to the driver.
    taken = rows.sparkSession.createDataFrame(
        sorted(zip(known_rows["id"].to_pylist(), known_rows["key"].to_pylist(), strict=True)), rows.select("id", text_key).schema
    )
    outside = score(rows.filter(fold("id") != 0).select("id", "lang", text_key, "text"), model)
    step = F.round(F.ln(F.col("score") / (1 - F.col("score"))) / STEP).cast("int").alias("step")
    outside = outside.select("id", "lang", "key", step).join(F.broadcast(taken), ["id", "key"], "left_anti")
    outside = outside.groupBy("id", "lang", "step").agg(F.count(F.lit(1)).alias("n")).join(every, "id")
    counted = outside.groupBy("lang", "label", "step").agg(F.sum("n").alias("n")).orderBy("lang", "label", "step").collect()
    label = np.concatenate([truth, [float(r["label"]) for r in counted]])
    of = np.concatenate([langs, np.array([r["lang"] for r in counted], dtype=object)])
    n = np.concatenate([np.ones(len(truth)), [float(r["n"]) for r in counted]])
    usable = np.concatenate([part == PARTS - 1, np.ones(len(counted), dtype=bool)])
    least = lambda rows: min((n * label)[rows].sum(), (n * (1 - label))[rows].sum())
    if any(least(mine & usable) < LEAST_LABELLED <= least(mine) for mine in [of == x for x in set(of)]):
        without(*range(PARTS - 1))
        usable[:] = True
    steps = np.concatenate([steps, [r["step"] for r in counted]])
    calibrate(model, 1 / (1 + np.exp(-steps[usable] * STEP)), label[usable], of[usable], n[usable])
    return model


# Words scored at once: bounds the memory of a task, whatever a batch holds, but for one text of more words.
CHUNK_WORDS = 20_000


def _scorer(model: Model):
    """Scores of batches of texts. A text is taken out of its Arrow batch only while its words are hashed."""

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        buckets, tables = Buckets(), model.tables()
        for part in parts:
            out, waiting, words = [], [], 0
            for t in part:
                waiting.append(buckets.of(t.as_py()))
                words += len(waiting[-1])
                if words >= CHUNK_WORDS:
                    out.append(scores(model, tables, waiting))
                    waiting, words = [], 0
            if waiting:
                out.append(scores(model, tables, waiting))
            yield pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return run


def score(docs: DataFrame, model: Model, text="text", lang="lang") -> DataFrame:
    """``docs`` with ``score`` (0 to 1), ``threshold`` (that of its language) and ``rejected``.

    The score depends on the text alone. Null or empty text: the score of no words. Null or unknown language:
    the threshold of all languages. Repeated rows get equal scores. Very long texts are scored whole. Columns
    of the three names are replaced; others pass through.
    """
    kept = [c for c in docs.columns if c.lower() not in ("score", "threshold", "rejected")]

    run = _scorer(model)

    @F.arrow_udf("double")
    def scored(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run(parts)

    own = {k: v for k, v in model.thresholds.items() if k is not None}
    limit = F.lit(model.thresholds.get(None, 0.5))
    for name, value in own.items():
        limit = F.when(F.col(f"`{lang}`") == name, value).otherwise(limit)
    rest = docs.select(*[F.col(f"`{c}`") for c in kept])
    return rest.withColumn("score", scored(text_of(f"`{text}`"))).withColumn("threshold", limit).withColumn(
        "rejected", F.col("score") >= F.col("threshold")
    )
