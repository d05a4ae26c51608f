"""Language-model scoring with a log-frequency Bloom filter.

Counts of words and word pairs are quantised to powers of two; a gram of level q is in the filter q times,
once with each of the numbers 1 to q. A query probes 1, 2, ... until one is missing: the last one found is
the level. The filter takes ``BITS_EACH`` to twice as many bits for each gram and level counted, at any size.
A pair's probability mixes its relative count with the word's own probability; the weight of the
latter, by the level of the first word, is the share of training tokens whose pair occurs only once.

Building: each task counts its grams as arrays and sends them, grouped by filter segment, as packed keys
and counts; a group's task adds them up, and sets the bits of as many segments as they need. Counts cover all
training texts.

A filter of up to ``MAX_BROADCAST`` bits is broadcast. The groups of a larger one stay in a written table:
chunks of texts send their distinct keys to the groups, and get levels and exact counts back. Both ways find
the same levels, so that the scores do not depend on the way.

The unigram baseline needs the exact count of every token. With a broadcast filter, up to ``MAX_VOCAB``
distinct words have their hashes and counts broadcast; beyond that each text's words are joined with the
counts by a shuffle.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.llm.common import bounded, texts_of, written

SEGMENT_BITS = 20
#: Least bits of the filter for each gram and level; a group's bits are a power of two.
BITS_EACH = 10
#: Bits of the largest filter that is broadcast (8 MB).
MAX_BROADCAST = 1 << 26
PROBES, MAX_LEVEL = 4, 40
MAX_VOCAB = 8_000_000
#: Tokens that a task counts before it sends what it has.
FLUSH = 1_500_000
#: Bytes of the texts whose tokens are looked up together.
TOGETHER = 1 << 18
#: Bytes of the texts that ask a filter in groups together.
CHUNK_BYTES = 8_000_000
#: Hashes of the end and the start of a text, and what tells pairs from words.
END, START = np.uint64(0x6A09E667F3BCC908), np.uint64(0xBB67AE8584CAA73B)
_PAIR, _LEVEL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)
_MASK, _BIT = np.uint64((1 << SEGMENT_BITS) - 1), np.array([1, 2, 4, 8, 16, 32, 64, 128], np.uint8)
#: What stands for the counts of a level: the middle of 2**(q-1) ... 2**q - 1.
COUNT_OF = np.array([0.0, *((2.0 ** (q - 1) + 2.0**q - 1) / 2 for q in range(1, MAX_LEVEL + 1))])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def token_hashes(text: bytes | None) -> np.ndarray:
    """Hashes of the lower-cased (A-Z) words, then of the end."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    out[-1] = END
    return out


def pair_keys(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return _mix(before * _PAIR + tokens)


def with_history(tokens: np.ndarray) -> np.ndarray:
    """The token before each one of a text."""
    return np.concatenate([[START], tokens[:-1]])


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(MAX_LEVEL, 1 + np.floor(np.log2(counts)).astype(np.int64))


def _segment(keys: np.ndarray, size: int, skip: int = 0) -> np.ndarray:
    """First bit of each key's segment, without the first ``skip`` bits of the key; all levels of a key are in one."""
    if size == SEGMENT_BITS:
        return np.zeros(len(keys), np.uint64)
    return (keys << np.uint64(skip) >> np.uint64(64 - (size - SEGMENT_BITS))) << np.uint64(SEGMENT_BITS)


def _by_group(keys: np.ndarray, skip: int) -> list[tuple[int, slice]]:
    """Groups of ascending keys, by their first ``skip`` bits, and where they are."""
    group = keys >> np.uint64(64 - skip) if skip else np.zeros(len(keys), np.uint64)
    at = np.flatnonzero(np.diff(group, prepend=group[:1] + np.uint64(1)))
    return [(int(group[b]), slice(b, e)) for b, e in zip(at, [*at[1:], len(keys)], strict=True)]


def _walk(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the probes of (key, level) begin, and their step."""
    x = _mix(keys + np.uint64(level * int(_LEVEL) % 2**64))
    return x, (x >> np.uint64(32)) | np.uint64(1)


def segment_bits(grams: list[tuple[np.ndarray, np.ndarray]]) -> bytes:
    """Bits of one segment that holds the counted keys."""
    bits = np.zeros(1 << SEGMENT_BITS, bool)
    for keys, counts in grams:
        levels = levels_of(counts)
        for level in range(1, int(levels.max(initial=0)) + 1):
            x, step = _walk(keys[levels >= level], level)
            for i in range(PROBES):
                bits[(x + np.uint64(i) * step & _MASK).view(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def group_bits(grams: list[tuple[np.ndarray, np.ndarray]], skip: int) -> bytes:
    """Bits of all segments of a group, whose keys agree in their first ``skip`` bits."""
    inserted = sum(int(levels_of(counts).sum()) for _, counts in grams)
    size = max(SEGMENT_BITS, (max(1, BITS_EACH * inserted) - 1).bit_length())
    segment = [_segment(keys, size, skip) >> np.uint64(SEGMENT_BITS) for keys, _ in grams]
    own = ([s == k for s in segment] for k in range(1 << (size - SEGMENT_BITS)))
    return b"".join(segment_bits([(keys[o], counts[o]) for (keys, counts), o in zip(grams, x, strict=True)]) for x in own)


def probe(bits: np.ndarray, keys: np.ndarray, size: int, skip: int = 0) -> np.ndarray:
    """Level of each key: the number of probes in a row that succeed. A key leaves at its first missing bit."""
    level, alive, segment = np.zeros(len(keys), np.int64), np.arange(len(keys)), _segment(keys, size, skip)
    for q in range(1, MAX_LEVEL + 1):
        x, step = _walk(keys, q)
        for i in range(PROBES):
            at = segment | (x + np.uint64(i) * step & _MASK)
            found = np.flatnonzero(bits.take((at >> np.uint64(3)).view(np.int64)) & _BIT.take((at & np.uint64(7)).view(np.int64)))
            if len(found) < len(at):
                x, step, segment, keys, alive = x[found], step[found], segment[found], keys[found], alive[found]
        if not len(alive):
            break
        level[alive] = q
    return level


def held_out(id_col: str, folds: int = 10) -> F.col:
    """Whether the CRC-32 of the id as text leaves no remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def gram_counts(texts: DataFrame, skip: int) -> DataFrame:
    """Counts of words (kind 0) and pairs (kind 1) as packed arrays by group, added up for each task."""
    import pyarrow as pa

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            out = []
            for kind in (0, 1):
                keys, counts = np.unique(np.concatenate([h[kind] for h in held]), return_counts=True)
                out += [(group, kind, keys[at].astype("<u8").tobytes(), counts[at].astype("<u4").tobytes()) for group, at in _by_group(keys, skip)]
            held.clear()
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
            for k in range(0, len(out), 256):
                columns = zip(*out[k : k + 256], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["segment", "kind", "keys", "counts"])

        size_held = 0
        for batch in bounded(batches, 0):
            for x in texts_of(batch):
                tokens = token_hashes(x)
                # A text's start is counted once, as the history of its first token.
                held.append((np.append(tokens, START), pair_keys(with_history(tokens), tokens)))
                size_held += len(tokens)
                if size_held > FLUSH:
                    yield from flush()
                    size_held = 0
        if held:
            yield from flush()

    return texts.mapInArrow(run, "segment int, kind int, keys binary, counts binary")


def built(grams: DataFrame, skip: int) -> DataFrame:
    """For each group: its words with exact counts, and its bits of the filter."""
    import pyarrow as pa

    def add(group: pa.Table) -> pa.Table:
        segment, kinds = group.column("segment")[0].as_py(), np.array(group.column("kind").to_pylist())
        keys, counts = group.column("keys").to_pylist(), group.column("counts").to_pylist()
        grams = []
        for kind in (0, 1):
            own = np.flatnonzero(kinds == kind)
            every, at = np.unique(np.frombuffer(b"".join(keys[i] for i in own), "<u8"), return_inverse=True)
            grams.append((every, np.bincount(at, np.frombuffer(b"".join(counts[i] for i in own), "<u4"), len(every)).astype("<i8")))
        words = grams[0][0] != START
        row = [segment, grams[0][0][words].tobytes(), grams[0][1][words].tobytes(), group_bits(grams, skip)]
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["segment", "words", "counts", "bits"])

    return grams.groupBy("segment").applyInArrow(add, "segment int, words binary, counts binary, bits binary")


@dataclass
class Tables:
    """What goes to the tasks: the filter, and the exact word counts if they are few enough."""

    size: int
    bits: np.ndarray
    words: np.ndarray | None
    counts: np.ndarray | None

    def levels(self, tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct tokens, where each one of all texts in a row is among them, their levels, and by token the
        levels of the one before it and of the pair."""
        flat, before = np.concatenate(tokens), np.concatenate([with_history(t) for t in tokens])
        at, every = pd.factorize(flat)
        word, pair = probe(self.bits, every, self.size), probe(self.bits, pair_keys(before, flat), self.size)
        history = np.concatenate([[0], word[at[:-1]]])
        starts = np.cumsum([0, *(len(t) for t in tokens[:-1])])
        history[starts] = probe(self.bits, np.array([START]), self.size)[0]
        return every, at, word, history, pair


@dataclass
class Model:
    """``tables`` is a broadcast of Tables, or None where the filter is too large for it: then ``levels`` has
    the levels of the texts of ``docs``."""

    tables: object
    built: DataFrame
    skip: int
    n: int
    v: int
    novelty: np.ndarray
    docs: tuple | None = None
    levels: DataFrame | None = None


def _slices(batches, at: int):
    """Some rows of the batches after the others, with the token hashes of their texts in column ``at``."""
    for part in bounded(batches, at, TOGETHER):
        yield part, [token_hashes(x) for x in texts_of(part)]


def _novelty(texts: DataFrame, pairs_of) -> np.ndarray:
    """By level of the first word: the share of training tokens whose pair occurs once. ``pairs_of`` gives the
    levels of the first word and of the pair for tokens of a batch."""
    import pyarrow as pa

    def run(batches):
        total, once = np.zeros(MAX_LEVEL + 1, np.int64), np.zeros(MAX_LEVEL + 1, np.int64)
        for batch in batches:
            for history, pair in pairs_of(batch):
                total += np.bincount(history, minlength=MAX_LEVEL + 1)
                once += np.bincount(history[pair <= 1], minlength=MAX_LEVEL + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(MAX_LEVEL + 1)), pa.array(total), pa.array(once)], ["level", "total", "once"])

    rows = texts.mapInArrow(run, "level bigint, total bigint, once bigint")
    found = rows.groupBy("level").agg(F.sum("total").alias("total"), F.sum("once").alias("once")).collect()
    share = np.ones(MAX_LEVEL + 1)
    for r in found:
        share[r["level"]] = (r["once"] + 1) / (r["total"] + 1)
    return np.clip(share, 0.001, 0.999)


def _gathered(rows: DataFrame, skip: int, few: bool) -> Tables:
    """The whole filter, where a group with fewer segments than the largest has copies of them, and the words."""
    found = [(r["segment"], np.frombuffer(r["bits"], np.uint8)) for r in rows.select("segment", "bits").toLocalIterator()]
    per = max((len(b) for _, b in found), default=(1 << SEGMENT_BITS) // 8)
    bits = np.zeros(per << skip, np.uint8)
    for k, b in found:
        segments = b.reshape(-1, (1 << SEGMENT_BITS) // 8)
        bits[k * per : (k + 1) * per] = np.repeat(segments, per // len(b), axis=0).reshape(-1)
    words = counts = None
    if few:
        held = [(np.frombuffer(r["words"], "<u8"), np.frombuffer(r["counts"], "<i8")) for r in rows.select("words", "counts").toLocalIterator()]
        words, counts = (np.concatenate([h[k] for h in held] or [np.zeros(0, np.int64)]) for k in (0, 1))
        words = words.astype(np.uint64)
        order = np.argsort(words)
        words, counts = words[order], counts[order]
        counts = counts.astype(np.uint32) if counts.max(initial=0) < 2**32 else counts
    return Tables((len(bits) * 8 - 1).bit_length(), bits, words, counts)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, max_vocab: int = MAX_VOCAB, max_broadcast: int = MAX_BROADCAST) -> Model:
    """Learn from all texts outside the held-out fold; null texts are empty ones."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("bigint"))).first()[0] or 0
    # A group has 2 to 4 MB of text.
    skip = max(0, max(0, total // 2 - 1).bit_length() - SEGMENT_BITS)
    texts = docs.where(~held_out(id_col, folds)).select(F.col(text_col).cast("string").alias("text"))
    rows = _written_alone(built(gram_counts(texts, skip), skip), "lm-counts")
    sizes = rows.agg(F.sum(F.octet_length("words").cast("bigint")).alias("words"), F.max(F.octet_length("bits").cast("bigint")).alias("bits")).first()
    n, v = _exact_total(rows), (sizes["words"] or 0) // 8
    if (sizes["bits"] or 0) * 8 << skip > max_broadcast:
        levels = levels_by_shuffle(docs, rows, skip, n, v, id_col, text_col)
        novelty = _novelty(levels.where(~held_out("id", folds)).select("start", "word", "pair"), _stored)
        return Model(None, rows, skip, n, v, novelty, (docs, id_col, text_col), levels)
    tables = spark.sparkContext.broadcast(_gathered(rows, skip, v <= max_vocab))
    pairs_of = lambda batch: (tables.value.levels(t)[3:] for _, t in _slices([batch], 0))
    return Model(tables, rows, skip, n, v, _novelty(texts, pairs_of))


def _written_alone(df: DataFrame, name: str) -> DataFrame:
    """``written``, with its shuffle files removed at the end, so that those of several steps do not add up."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return written(df, name, "zstd")
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


# -- a filter that is not broadcast --------------------------------------------------------------


def _stored(batch):
    """Levels of the word before and of the pair, for all tokens of rows with ``start``, ``word``, ``pair``."""
    start, word, pair = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("start", "word", "pair"))
    for s, w, p in zip(start, word, pair, strict=True):
        yield np.append(s, np.frombuffer(w, np.uint8)[:-1]).astype(np.int64), np.frombuffer(p, np.uint8)


def _in_chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``chunk``, ``id``, ``text``, where texts in a row have a chunk together."""
    import pyarrow as pa

    def run(batches):
        chunk, held = uuid.uuid4().hex, 0
        for batch in batches:
            names = []
            for x in texts_of(batch):
                if held > CHUNK_BYTES:
                    chunk, held = uuid.uuid4().hex, 0
                names.append(chunk)
                held += len(x or b"") + 100
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *batch.columns], ["chunk", "id", "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return written(rows.mapInArrow(run, f"chunk string, id {kind}, text string"), "lm-chunks", "zstd")


def _keys_of(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Words, the start first, and pairs of texts."""
    flat, before = np.concatenate(tokens), np.concatenate([with_history(t) for t in tokens])
    return np.append(START, flat), pair_keys(before, flat)


def _asked(chunks: DataFrame, skip: int) -> DataFrame:
    """Distinct ascending keys of the chunks' words and pairs, by group. A chunk in two tasks asks twice."""
    import pyarrow as pa

    kinds = (pa.int32(), pa.string(), pa.int32(), pa.binary())

    def ask(chunk, tokens):
        out = []
        for kind, keys in enumerate(map(np.unique, _keys_of(tokens))):
            out += [(group, chunk, kind, keys[at].astype("<u8").tobytes()) for group, at in _by_group(keys, skip)]
        for k in range(0, len(out), 256):
            columns = zip(*out[k : k + 256], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["segment", "chunk", "kind", "keys"])

    def run(batches):
        now, held = None, []
        for batch in batches:
            for chunk, x in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                if held and chunk != now:
                    yield from ask(now, held)
                    held = []
                now = chunk
                held.append(token_hashes(x))
        if held:
            yield from ask(now, held)

    return chunks.select("chunk", "text").mapInArrow(run, "segment int, chunk string, kind int, keys binary")


def _answered(asked: DataFrame, rows: DataFrame, skip: int) -> DataFrame:
    """Levels of the distinct ascending keys of a chunk in a group, and the exact counts of words."""
    import pyarrow as pa

    def answer(asked: pa.Table, group: pa.Table) -> pa.Table:
        own: dict[tuple[str, int], list[bytes]] = {}
        for chunk, kind, keys in zip(*(asked.column(c).to_pylist() for c in ("chunk", "kind", "keys")), strict=True):
            own.setdefault((chunk, kind), []).append(keys)
        parts = [np.frombuffer(k[0], "<u8") if len(k) == 1 else np.unique(np.frombuffer(b"".join(k), "<u8")) for k in own.values()]
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        level, words = np.zeros(len(flat), np.uint8), np.zeros(0, np.uint64)
        if len(group):
            bits, words, counts = (np.frombuffer(group.column(c)[0].as_py(), t) for c, t in (("bits", np.uint8), ("words", "<u8"), ("counts", "<i8")))
            level = probe(bits, flat, (len(bits) * 8 - 1).bit_length(), skip).astype(np.uint8)
        out, end = [], 0
        for (chunk, kind), keys in zip(own, parts, strict=True):
            begin, end, c = end, end + len(keys), np.zeros(0, "<i8")
            if kind == 0:
                c = np.zeros(len(keys), "<i8")
                if len(words):
                    place = np.minimum(np.searchsorted(words, keys), len(words) - 1)
                    c = np.where(words[place] == keys, counts[place], 0)
            out.append((chunk, asked.column("segment")[0].as_py(), kind, level[begin:end].tobytes(), c.astype("<i8").tobytes()))
        columns = zip(*out, strict=True) if out else [()] * 5
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["chunk", "segment", "kind", "levels", "counts"])

    return asked.groupBy("segment").cogroup(rows.groupBy("segment")).applyInArrow(answer, "chunk string, segment int, kind int, levels binary, counts binary")


def levels_by_shuffle(docs: DataFrame, rows: DataFrame, skip: int, n: int, v: int, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``n_tokens``, ``n_known``, ``base_score``, and the levels of the start, each word and each pair of every text."""
    import pyarrow as pa

    model_log = _word_log10(n, v)
    kind = docs.schema[id_col].dataType.simpleString()
    chunks = _in_chunks(docs, id_col, text_col)
    names = ["id", "n_tokens", "n_known", "base_score", "start", "word", "pair"]

    def finish(texts: pa.Table, answers: pa.Table) -> pa.Table:
        tokens = [token_hashes(x) for x in texts.column("text").cast(pa.binary()).to_pylist()]
        found = sorted(zip(*(answers.column(c).to_pylist() for c in ("kind", "segment", "levels", "counts")), strict=True))
        word_at, pair_at = (np.unique(k, return_inverse=True)[1] for k in _keys_of(tokens))
        word, pair = (np.frombuffer(b"".join(f[2] for f in found if f[0] == k), np.uint8) for k in (0, 1))
        counts = np.frombuffer(b"".join(f[3] for f in found), "<i8")
        lengths = np.array([len(t) for t in tokens])
        ends, text = np.cumsum(lengths), np.repeat(np.arange(len(tokens)), lengths)
        start, word, pair, c = int(word[word_at[0]]), word[word_at[1:]], pair[pair_at], counts[word_at[1:]]
        columns = [
            pa.array(lengths.astype(np.int64)), pa.array(np.bincount(text, c > 0).astype(np.int64)), pa.array(np.bincount(text, model_log(c))),
            pa.array([start] * len(tokens), pa.int32()), *(pa.array([x[e - k : e].tobytes() for e, k in zip(ends, lengths, strict=True)], pa.binary()) for x in (word, pair)),
        ]
        return pa.table([texts.column("id"), *columns], names)

    answers = _written_alone(_answered(_asked(chunks, skip), rows, skip), "lm-answers")
    out = f"id {kind}, n_tokens bigint, n_known bigint, base_score double, start int, word binary, pair binary"
    return _written_alone(chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, out), "lm-levels")


def _scores_by_shuffle(docs: DataFrame, model: Model, id_col: str, text_col: str, folds: int) -> DataFrame:
    import pyarrow as pa

    same = model.docs is not None and model.docs[0] is docs and model.docs[1:] == (id_col, text_col)
    levels = model.levels if same else levels_by_shuffle(docs, model.built, model.skip, model.n, model.v, id_col, text_col)
    novelty, single = model.novelty, 10.0 ** _word_log10(model.n, model.v)(COUNT_OF)

    def run(batches):
        for batch in batches:
            words = batch.column(batch.schema.get_field_index("word")).to_pylist()
            scores = [_score(h, p.astype(np.int64), single[np.frombuffer(w, np.uint8)], novelty).sum() for w, (h, p) in zip(words, _stored(batch), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(scores, pa.float64())], ["id", "n_tokens", "n_known", "base_score", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = levels.mapInArrow(run, f"id {kind}, n_tokens bigint, n_known bigint, base_score double, score double")
    return _columns(out, model, id_col, folds)


def _score(history, pair, single, novelty):
    both = np.minimum(COUNT_OF[pair], COUNT_OF[history]) / np.maximum(COUNT_OF[history], 1.0)
    return np.log10((1 - novelty[history]) * both + novelty[history] * single)


def _columns(out: DataFrame, model: Model, id_col: str, folds: int) -> DataFrame:
    return out.select(
        F.col("id").alias(id_col), held_out("id", folds).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("bigint").alias("train_tokens"), "base_score", "score"
    )


# -- scores --------------------------------------------------------------------------------------


def word_rows(rows: DataFrame) -> DataFrame:
    """``h``, ``c``: the hash of every training word (as a signed long) and its exact count."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(w, "<i8")), pa.array(np.frombuffer(c, "<i8"))], ["h", "c"])

    return rows.select("words", "counts").mapInArrow(run, "h bigint, c bigint")


def _exact_total(rows: DataFrame) -> int:
    return int(word_rows(rows).agg(F.sum("c")).first()[0] or 0)


def _base_by_join(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """``key`` (SHA-256 of a text), ``n_known``, ``base_score``: each text's distinct words joined with their counts.

    Copies of a text add up to multiples of its sums; the end, once in each, tells how many they are.
    """
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                h, tf = np.unique(token_hashes(text).view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(h), pa.string()), pa.array(h), pa.array(tf)], ["key", "h", "tf"])

    texts = docs.select(_key(text_col), F.col(text_col).cast("string").alias("text"))
    counted = texts.mapInArrow(run, "key string, h bigint, tf bigint").join(word_rows(model.built), "h", "left")
    log = F.log10((F.coalesce("c", F.lit(0)) + F.lit(0.1)) / F.lit(model.n + 0.1 * (model.v + 1)))
    sums = counted.groupBy("key").agg(
        F.sum(F.when(F.col("h") == F.lit(int(END.view(np.int64))), F.col("tf"))).alias("copies"),
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("known"),
        F.sum(F.col("tf") * log).alias("base"),
    )
    return sums.select("key", F.expr("known div copies").alias("n_known"), (F.col("base") / F.col("copies")).alias("base_score"))


def _key(text_col: str):
    return F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256).alias("key")


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """Scores of every row; see the module. A null or empty text is its end alone; repeated rows stay, a row without an id is
    one of the held-out or the training rows by the hash of no id, and an empty table gives no rows. Very long texts are
    scored whole. No column but the id and the text is read.

    Returns ``id_col``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``
    (log10 of the text's probability under the model).
    """
    import pyarrow as pa

    if model.tables is None:
        return _scores_by_shuffle(docs, model, id_col, text_col, folds)
    tables, novelty, few = model.tables, model.novelty, model.tables.value.words is not None

    def run(batches):
        for part, tokens in _slices(batches, 2):
            yield score(part, tokens)

    def score(batch, tokens):
        t, lengths = tables.value, np.array([len(x) for x in tokens])
        text = np.repeat(np.arange(len(tokens)), lengths)
        every, at, word, history, pair = t.levels(tokens)
        single = (10.0 ** model_log(COUNT_OF[word]))[at]
        scores = np.bincount(text, _score(history, pair, single, novelty))
        base, known = np.zeros(len(tokens)), np.zeros(len(tokens), np.int64)
        if few:
            c = np.zeros(len(every), np.int64)
            if len(t.words):
                place = np.minimum(np.searchsorted(t.words, every), len(t.words) - 1)
                c = np.where(t.words[place] == every, t.counts[place], 0)
            base, known = np.bincount(text, model_log(c)[at]), np.bincount(text, (c > 0)[at]).astype(np.int64)
        columns = [pa.array(lengths.astype(np.int64)), pa.array(known), pa.array(base), pa.array(scores)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "key", "n_tokens", "n_known", "base_score", "score"])

    model_log = _word_log10(model.n, model.v)
    kind = docs.schema[id_col].dataType.simpleString()
    key = F.lit(None).cast("string").alias("key") if few else _key(text_col)
    rows = docs.select(F.col(id_col).alias("id"), key, F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, key string, n_tokens bigint, n_known bigint, base_score double, score double")
    if not few:
        out = out.drop("n_known", "base_score").join(_base_by_join(docs, model, text_col), "key")
    return _columns(out, model, id_col, folds)


def _word_log10(n: int, v: int):
    return lambda counts: np.log10((counts + 0.1) / (n + 0.1 * (v + 1)))
