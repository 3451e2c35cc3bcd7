"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Characters' 1- to 3-grams are hashed to ``BUCKETS``. A feature's value is its
share of the text's n-grams times its inverse document frequency over all
documents that may be learnt from. The weights are learnt by
follow-the-regularised-leader with elastic-net penalties, which leaves most of
them 0, on a bounded sample of labelled documents of each language. The temperature of
the probabilities comes from a fifth of each language's sample, by weights learnt from
the rest; then the weights are learnt from all of it. A prediction is linear in the n-gram counts, so it is one look-up a character and order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import bounded_batches, fresh, table

BITS = 16
BUCKETS = 1 << BITS
ORDERS = 3
SCALE = 64.0
#: The bound of the sample: about so many labelled documents of a language, by a hash of their ids.
SAMPLE_PER_LANG = 600
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.05, 0.01
#: Code points that are handled at once.
CHUNK = 250_000
UNKNOWN = "und"


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of lower-cased texts one after another, each followed by two blanks; starts and lengths."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("".join(f"{t}  " for t in lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, lowered), np.int64, len(lowered))
    return codes, np.cumsum(lengths + 2) - lengths - 2, lengths


def _grams(codes: np.ndarray) -> list[np.ndarray]:
    """For each order, the bucket of the n-gram that starts at each code point (the last ones run into blanks)."""
    h, out = np.zeros(len(codes), np.uint32), []
    for n in range(ORDERS):
        later = codes if n == 0 else np.concatenate([codes[n:], np.full(n, 32, np.uint32)])
        h = (h + later + np.uint32(n + 1)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        out.append((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS))
    return out


def _chunks(texts: list[str]):
    """(first, texts) with about CHUNK code points at most, or one longer text, which is then read by windows."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield first, texts[first:k]
            first, size = k, 0
        size += len(t)
    if first < len(texts):
        yield first, texts[first:]


def _windows(codes: np.ndarray, length: int):
    """For each CHUNK code points of one text their n-grams' buckets, by order."""
    for k in range(0, length, CHUNK):
        n = min(CHUNK, length - k)
        yield [g[:n] for g in _grams(codes[k : k + n + ORDERS - 1])]


def counted(texts: list[str]):
    """For each text (buckets, counts)."""
    for _, part in _chunks(texts):
        codes, starts, lengths = _codes(part)
        if len(part) == 1 and lengths[0] > CHUNK:
            n = np.zeros(BUCKETS, np.int64)
            for grams in _windows(codes, lengths[0]):
                for g in grams:
                    n += np.bincount(g, minlength=BUCKETS)
            at = np.flatnonzero(n)
            yield at.astype(np.uint32), n[at]
            continue
        grams = _grams(codes)
        for s, n in zip(starts, lengths, strict=True):
            yield np.unique(np.concatenate([g[s : s + n] for g in grams]), return_counts=True)


def _frequencies(batches):
    df, n = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for buckets, _ in counted(batch.column("text").to_pylist()):
            df[buckets] += 1
            n += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], n), pa.int64())], ["bucket", "n"])


def _sample(batches):
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            part = batch.slice(k, 64)
            rows = list(counted(part.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([part.column("order"), part.column("lang"), pa.array([b.astype("<u2").tobytes() for b, _ in rows], pa.binary()), pa.array([c.astype("<u4").tobytes() for _, c in rows], pa.binary())], ["order", "lang", "buckets", "counts"])


class Model:
    """langs, weights (BUCKETS x langs, with IDF and scale in them), bias, temperature."""

    def __init__(self, langs: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.langs, self.weights, self.bias, self.temperature = langs, weights, bias, temperature

    def logits(self, texts: list[str]) -> np.ndarray:
        out = np.tile(self.bias, (len(texts), 1))
        for first, part in _chunks(texts):
            codes, starts, lengths = _codes(part)
            some = np.flatnonzero(lengths)
            if not len(some):
                continue
            if len(part) == 1 and lengths[0] > CHUNK:
                sums = [self.weights[g].sum(0, dtype=np.float64) for grams in _windows(codes, lengths[0]) for g in grams]
                out[first] += sum(sums) / (ORDERS * lengths[0])
                continue
            edges = np.stack([starts[some], starts[some] + lengths[some]], 1).ravel()
            total = np.zeros((len(some), len(self.langs)))
            for g in _grams(codes):
                total += np.add.reduceat(self.weights[g], edges, axis=0, dtype=np.float64)[::2]
            out[first + some] += total / (ORDERS * lengths[some, None])
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        p = _softmax(self.logits(texts) / self.temperature)
        best = p.argmax(1)
        return [self.langs[k] for k in best], p[np.arange(len(p)), best]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over (buckets, values, class); the bias is one more feature, not penalised by L1."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))
    l1 = np.full(BUCKETS + 1, L1)
    l1[BUCKETS] = 0

    def weights(at):
        zs = z[at]
        return -np.sign(zs) * np.maximum(np.abs(zs) - l1[at, None], 0) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for buckets, values, y in rows:
            at, x = np.append(buckets, BUCKETS), np.append(values, 1.0)
            w = weights(at)
            error = _softmax(x @ w)
            error[y] -= 1
            g = x[:, None] * error
            squares = g * g
            z[at] += g - (np.sqrt(n[at] + squares) - np.sqrt(n[at])) / ALPHA * w
            n[at] += squares
    w = weights(np.arange(BUCKETS + 1))
    return w[:BUCKETS], w[BUCKETS]


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature from 0.25 to 8 with the least log loss, by golden-section search."""
    loss = lambda t: -np.log(np.maximum(_softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean()
    a, b, g = np.log(0.25), np.log(8.0), (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_per_lang: int = SAMPLE_PER_LANG) -> Model | None:
    """A model from the documents that have an id, a text and a language and aren't held out; None if there are none.

    Document frequencies cover all of them, and whole texts. The weights come from about
    ``sample_per_lang`` documents of each language, the same ones in each run; every
    language with a document that has an n-gram in the sample is learnt. The driver gets a
    row a bucket, a row a language and the sample: a model takes about 1 MB a language
    while it is learnt, and 0.25 MB in a worker. Rows with equal ids (repeated rows) are in
    the sample together or not at all; order among equal ones doesn't matter.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id")))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not sizes:
        return None
    langs = sorted(sizes)
    idf = np.zeros(BUCKETS)
    df = rows.select("text").mapInArrow(_frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most a row a bucket
    total = int(df.loc[df["bucket"] < 0, "n"].sum())
    df = df[df["bucket"] >= 0]
    idf[df["bucket"].to_numpy()] = np.log((1 + total) / (1 + df["n"].to_numpy())) + 0.05

    order = F.xxhash64(F.col("id").cast("string"), F.lit(17))
    share = F.shiftrightunsigned(order, 11).cast("double") / float(1 << 53)
    rates = docs.sparkSession.createDataFrame([(lang, min(1.0, sample_per_lang / n)) for lang, n in sizes.items()], "lang string, rate double")
    chosen = rows.join(F.broadcast(rates), "lang").where(share < F.col("rate"))  # a row a language
    picked = chosen.select(order.alias("order"), "lang", "text").mapInArrow(_sample, "order long, lang string, buckets binary, counts binary").collect()
    number = {lang: k for k, lang in enumerate(langs)}
    examples, seen, rest = [], [0] * len(langs), []
    for r in sorted(picked, key=lambda r: (r["order"], r["lang"], r["buckets"], r["counts"])):
        buckets, counts = np.frombuffer(r["buckets"], "<u2").astype(np.int64), np.frombuffer(r["counts"], "<u4")
        if len(buckets):
            y = number[r["lang"]]
            seen[y] += 1
            rest.append(seen[y] % 5 == 0)  # so the first four of a language are learnt from
            examples.append((buckets, SCALE * counts / counts.sum() * idf[buckets], y))
    if not examples:
        return None
    temperature = 1.0
    if any(rest):
        w, bias = ftrl([x for x, aside in zip(examples, rest, strict=True) if not aside], len(langs))
        aside = [x for x, held in zip(examples, rest, strict=True) if held]
        temperature = calibrate(np.array([(x[1] @ w[x[0]]) + bias for x in aside]), np.array([x[2] for x in aside]))
    w, bias = ftrl(examples, len(langs))
    return Model(langs, (SCALE * idf[:, None] * w).astype(np.float32), bias, temperature)


def predict(docs: DataFrame, model: Model | None, *, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """The columns of ``docs`` but the text, and the prediction.

    Null texts and texts without a letter: und, 0.0; so all without a model. Of languages
    with equal probabilities the first by code point is taken. Long texts are read whole, by
    windows; one text must fit a task. A column named as a result is replaced, other names
    can't clash. No rows: no rows.
    """
    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (text_col, lang_out, score_out)]
    text = fresh(docs.columns, "_text")
    whole = F.col(f"`{text_col}`")
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.when(whole.rlike(r"\p{L}"), whole), F.lit("")).alias(text))
    schema = rows.drop(text).schema.add(lang_out, "string").add(score_out, "double")

    def run(batches):
        for batch in batches:
            texts = batch.column(text).to_pylist()
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if model is not None:
                known = [k for k, t in enumerate(texts) if t]
                if known:
                    found, sure = model.predict([texts[k] for k in known])
                    scores[known] = sure
                    for k, lang in zip(known, found, strict=True):
                        langs[k] = lang
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*kept, lang_out, score_out])

    return rows.mapInArrow(run, schema)


def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), train(docs))
