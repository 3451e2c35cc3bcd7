"""Token counts by the whole-token shortcut.

Proof, done once on the driver from the model's file alone: its normaliser changes
nothing but blanks to word marks, with one in front; no piece has a word mark after
another character, so no merge crosses from one pre-token (a run of blanks and the
word after it) to the next; and a piece that starts with the mark and encodes alone
to itself counts 1 wherever it is a whole pre-token. A text's
count is the number of such pre-tokens plus the tokens of the others, which are
merged together in one call, as pre-tokens don't affect each other.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import bounded_batches, table

MARK = "▁"
LIMIT = 4096
PRETOKEN = re.compile(" +[^ ]+| +$")


def _processor(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def _fields(raw: bytes):
    """(number, value) of each field of a protocol buffer message: an integer, or bytes."""

    def varint(at):
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if raw[at - 1] < 128:
                return value, at

    at = 0
    while at < len(raw):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


#: Fixed values of the model's format: its settings' field numbers and defaults.
TRAINER, NORMALIZER, SUFFIX = 2, 3, 24
CHARACTER_MAP, DUMMY_PREFIX, REMOVE_BLANKS, ESCAPE_BLANKS, RULES = 2, 3, 4, 5, 6


def plain_normaliser(model: bytes) -> bool:
    """Whether the model's settings leave texts as they are, but for a blank put before them and the blanks' marks."""
    settings = dict(_fields(model))  # the last of a kind counts; pieces aren't needed
    rules = {DUMMY_PREFIX: 1, REMOVE_BLANKS: 1, ESCAPE_BLANKS: 1} | dict(_fields(settings.get(NORMALIZER, b"")))
    suffix = dict(_fields(settings.get(TRAINER, b""))).get(SUFFIX, 0)
    return not rules.get(CHARACTER_MAP) and not rules.get(RULES) and (rules[DUMMY_PREFIX], rules[REMOVE_BLANKS], rules[ESCAPE_BLANKS], suffix) == (1, 0, 1, 0)


@lru_cache(4)
def whole_words(model: str) -> frozenset[str] | None:
    """Words that are one token by themselves; None if the model doesn't allow the shortcut."""
    sp = _processor(model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    split = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
    with open(model, "rb") as f:
        plain = plain_normaliser(f.read())
    if not (split and plain):
        return None
    words = [p[1:] for p in pieces if p.startswith(MARK) and MARK not in p[1:]]
    alone = sp.encode([w or MARK for w in words if w], num_threads=1)
    kept = {w for w, ids in zip([w for w in words if w], alone, strict=True) if len(ids) == 1}
    return frozenset(kept | ({""} if MARK in pieces else set()))


def count_tokens(sp, whole: frozenset[str] | None, texts: list[str]) -> list[int]:
    """Tokens of each text, exactly as ``sp`` gives them."""
    if whole is None:
        return [len(ids) for ids in sp.encode(texts, num_threads=1)]
    counts, rests, at = [], [], []
    for k, text in enumerate(texts):
        if MARK in text:
            text = text.replace(MARK, " ")
        if not text:
            counts.append(0)
            continue
        if "  " in text or text[0] == " " or text[-1] == " ":
            pre = PRETOKEN.findall(f" {text}")
            rest = "".join(p for p in pre if p[1:] not in whole)[1:]
            left = sum(p[1:] not in whole for p in pre)
        else:
            pre = text.split(" ")
            others = [w for w in pre if w not in whole]
            left, rest = len(others), " ".join(others)
        counts.append(len(pre) - left)
        if left:
            rests.append(rest)
            at.append(k)
    for k, ids in zip(at, sp.encode(rests, num_threads=1) if rests else [], strict=True):
        counts[k] += len(ids)
    return counts


def token_counts(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: a row a row of ``docs``.

    ``model`` is the path of a sentencepiece model on every machine. Null text is
    empty: 0 bytes, 0 tokens. Whole texts are counted, however long; ids (null,
    repeated) are carried along. Texts come in Arrow batches, a row's text must
    fit a Python worker.
    """
    bounded_batches(docs.sparkSession)
    whole = whole_words(model)

    def run(batches):
        sp = _processor(model)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts: list[int] = []
            for k in range(0, len(texts), 256):
                counts += count_tokens(sp, whole, texts[k : k + 256])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.binary_length(batch.column("text")).cast(pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op3_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
