"""Byte-level BPE encoding with tree concatenation for long unsplit text, and decoding.

Most of a text consists of short stretches between single spaces. A single space between two characters
that are not white space always begins a new pre-token, so these stretches encode independently of each
other; a bounded memo holds their ids, and those not seen yet are encoded by the library: a plain word with
punctuation after it as its two pre-tokens, all others in batches. A text in which a space meets other white
space goes to the library whole.

A long text as a whole is a tree: halves are cut down to leaves, wherever that is, all leaves of a batch are encoded
together, and neighbours are joined level by level. A join re-encodes the text around the seam, from so many
tokens before it to so many after it, and doubles their number until the new ids begin as the left side's and end as
the right side's and both the agreeing parts have a place where a single space begins a pre-token. What lies
before, between and after two such places encodes independently, so the joined ids are exact.

A stretch that the pre-tokenizer leaves unsplit and that is long (a hex run, a text in a script without
spaces) is encoded by tree concatenation: halves are cut down to leaves, all leaves are encoded in one
parallel batch, and neighbours are joined level by level. A join re-encodes a window around the seam and
grows it until its first tokens equal the left side's and its last tokens equal the right side's. A
sequence of BPE tokens is the encoding of its text exactly if every two neighbours are the encoding of
their own text; inside the halves and the window they are, and at the two places where they meet the
agreement makes them a pair that occurs in one of the encodings. So the joined ids are exact.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
import string
from array import array
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.llm.common import bounded

#: Characters above which an unsplit stretch is encoded as a tree, and of a leaf.
LONG, LEAF = 512, 256
#: Characters above which a text is encoded as a tree, and of a leaf.
LONG_TEXT, LEAF_TEXT = 8192, 4096
#: Characters in which a cut looks for a word.
NEAR = 64
#: Tokens of the first window on each side of a join, and tokens that have to agree on each side.
WINDOW, AGREE = 8, 2
#: Stretches in the memo, and the longest that it holds.
MEMO, MEMO_CHARS = 500_000, 48
#: Stretches that the library encodes as one text.
JOINED = 2000
#: What may follow a plain word as one pre-token, and what joins two lines.
_AFTER, _LINE = string.punctuation, "\n"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _halved(text: str) -> list[tuple[int, int]]:
    """Places of a text's leaves: one, or halves of halves. Cuts fall inside words where there is one near, since leaves that
    begin or end with white space take longer."""
    if len(text) <= LONG_TEXT:
        return [(0, len(text))]
    parts = 1 << (-(-len(text) // LEAF_TEXT) - 1).bit_length()
    cuts = [0]
    for k in range(1, parts):
        at = max(cuts[-1] + 1, len(text) * k // parts)
        near = next((x for x in range(at, min(at + NEAR, len(text))) if not text[x - 1].isspace() and not text[x].isspace()), at)
        if near < len(text):
            cuts.append(near)
    return list(zip(cuts, [*cuts[1:], len(text)], strict=True))


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """How many ids are equal from the beginning on."""
    differ = np.flatnonzero(a != b)
    return int(differ[0]) if len(differ) else len(a)


def _parts(raw: bytes, at: int) -> bool:
    """Whether a single space between two characters that are not white space begins here."""
    if raw[at] != 0x20 or at == 0 or at + 1 == len(raw):
        return False
    b, e = at - 1, at + 2
    while raw[b] & 0xC0 == 0x80:
        b -= 1
    while e < len(raw) and raw[e] & 0xC0 == 0x80:
        e += 1
    return not raw[b:at].decode().isspace() and not raw[at + 1 : e].decode().isspace()


def _threads(on: bool) -> None:
    """Whether the library encodes a batch on several threads; Spark gives a task one core, and short texts do not gain."""
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if on else "false"


class Codec:
    """Encodes and decodes as the tokenizers library does, without adding special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        _threads(False)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        # The model alone: a whole string is one unsplit stretch.
        self.model = Tokenizer(self.library.model)
        added = self.library.get_added_tokens_decoder()
        self.plain = not any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added.values())
        contents = sorted((t.content for t in added.values()), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, contents)) + ")") if contents else None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        # Only then are stretches between single spaces independent.
        self.by_stretch = (
            spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and self.plain
            and not any(" " in c for c in contents)
        )
        letters = byte_letters()
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.pieces, self.chars = [b""] * self.size, np.zeros(self.size, np.int64)
        added_ids = set(added)
        for token, i in vocab.items():
            self.pieces[i] = token.encode() if i in added_ids else bytes(letters[c] for c in token)
            self.chars[i] = len(token)
        self.spaced = np.array([p.startswith(b" ") for p in self.pieces])
        self.widths = np.array([len(p) for p in self.pieces], np.int64)
        #: Joins made in trees over whole texts.
        self.joins = 0
        self.memo: dict[str, bytes | None] = {}
        self.tails: dict[str, bytes] = {}
        self.letters = {b: ch for ch, b in letters.items()}
        self.tokenize = self.library.model.tokenize
        # Ids of a line feed; None where plain words with punctuation may hold an added token.
        apart = self.by_stretch and all(re.search(r"[^\w\n]\w", c) for c in contents)
        self.feed = array("I", [t.id for t in self.tokenize(self.letters[10])]).tobytes() if apart else None
        self.names = list(map(str, range(self.size)))

    # -- unsplit text ----------------------------------------------------------------------------

    def _encode_unsplit(self, stretches: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast(stretches, add_special_tokens=False)]

    def tree(self, stretch: str) -> np.ndarray:
        """Ids of one unsplit stretch in the vocabulary's letters."""
        cuts = [(0, len(stretch))]
        while any(e - b > LEAF for b, e in cuts):
            cuts = [c for b, e in cuts for c in (((b, (b + e) // 2), ((b + e) // 2, e)) if e - b > LEAF else ((b, e),))]
        _threads(True)
        nodes = list(zip(cuts, self._encode_unsplit([stretch[b:e] for b, e in cuts]), strict=True))
        _threads(False)
        while len(nodes) > 1:
            pairs = [nodes[k : k + 2] for k in range(0, len(nodes), 2)]
            joined = self._join_all(stretch, [p for p in pairs if len(p) == 2])
            nodes = [next(joined) if len(p) == 2 else p[0] for p in pairs]
        return nodes[0][1]

    def _join_all(self, stretch: str, pairs: list):
        """Join neighbours; the windows of all joins are encoded together, and again where they disagree."""
        out: list = [None] * len(pairs)
        width = dict.fromkeys(range(len(pairs)), WINDOW)
        while width:
            spans = {}
            for k, w in width.items():
                ((_, mid), left), (_, right) = pairs[k]
                spans[k] = (mid - int(self.chars[left[-w:]].sum()), mid + int(self.chars[right[:w]].sum()))
            windows = self._encode_unsplit([stretch[b:e] for b, e in spans.values()])
            for (k, w), ids in zip(list(width.items()), windows, strict=True):
                ((begin, _), left), ((_, end), right) = pairs[k]
                on_left = w >= len(left) or (ids[:AGREE] == left[-w:][:AGREE]).all()
                on_right = w >= len(right) or (ids[-AGREE:] == right[:w][-AGREE:]).all()
                if len(ids) >= AGREE and on_left and on_right or w >= max(len(left), len(right)):
                    out[k] = ((begin, end), np.concatenate([left[:-w] if w < len(left) else left[:0], ids, right[w:]]))
                    del width[k]
                else:
                    width[k] = 2 * w
        return iter(out)

    def _encode_long(self, text: str) -> np.ndarray:
        """Ids of a text that has or may have long unsplit stretches."""
        if not self.plain:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        parts = self.special.split(text) if self.special else [text]
        found = []
        for n, part in enumerate(parts):
            if n % 2:
                found.append(np.array([self.library.token_to_id(part)], np.uint32))
            elif part:
                short, pre = [], self.library.pre_tokenizer.pre_tokenize_str(part)
                for stretch, _ in pre:
                    if len(stretch) > LONG:
                        found += [*self._encode_unsplit(short), self.tree(stretch)] if short else [self.tree(stretch)]
                        short = []
                    else:
                        short.append(stretch)
                found += self._encode_unsplit(short) if short else []
        return np.concatenate(found) if found else np.zeros(0, np.uint32)

    # -- whole texts -----------------------------------------------------------------------------

    def _word(self, word: str, space: bool) -> bytes | None:
        """Ids of a plain word after a space or at the beginning of a line; None for other texts."""
        # Letters up to the Cyrillic ones, on which all versions of Unicode agree.
        if not word.isalpha() or not (word.isascii() or max(word) < "\u0500"):
            return None
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenize(self.letters[32] + letters if space else letters)]).tobytes()

    def _after(self, tail: str) -> bytes:
        """Ids of punctuation behind a word."""
        if tail not in self.tails:
            self.tails[tail] = array("I", [t.id for t in self.tokenize(tail)]).tobytes()
        return self.tails[tail]

    def _lines(self, text: str) -> bytes | None:
        """Ids after a space of plain words in lines that are not empty; None for others."""
        parts = []
        for x in text.split(_LINE):
            word = x.rstrip(_AFTER)
            ids = self._word(word, not parts)
            if ids is None:
                return None
            parts.append(ids + self._after(x[len(word) :]))
        return self.feed.join(parts)

    def _learn(self, stretches: set[str]) -> None:
        """Put stretches into the memo; None for one that does not encode by itself."""
        short, memo = [], self.memo
        if len(self.tails) > MEMO:
            self.tails.clear()
        for s in stretches:
            if self.feed is not None:
                word = s.rstrip(_AFTER)
                ids = memo.get(word)
                if ids is None and (ids := self._word(word, True)) is not None:
                    memo[word] = ids
                if ids is not None:
                    memo[s] = ids if len(word) == len(s) else ids + self._after(s[len(word) :])
                    continue
            if not s or s[0].isspace() or s[-1].isspace():
                memo[s] = None
            elif len(s) > LONG or self.special and self.special.search(s):
                memo[s] = self._encode_long(" " + s).astype("<u4").tobytes()
            elif self.feed is not None and (ids := self._lines(s)) is not None:
                memo[s] = ids
            else:
                short.append(s)
        # Joined by single spaces they encode as one text, in which only their first tokens begin with a space.
        for k in range(0, len(short), JOINED):
            part = short[k : k + JOINED]
            text = " " + " ".join(part)
            ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(self.spaced[ids])
            raw, cuts = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
            if len(at) != len(part):
                raise AssertionError("a stretch has a token that begins with a space")
            self.memo.update(zip(part, [raw[b:e] for b, e in itertools.pairwise(cuts)], strict=True))

    def _encode_texts(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Ids of texts by their stretches."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        split = [(t or "").split(" ") for t in texts]
        new = set().union(*(s[1:] for s in split)) - self.memo.keys()
        self._learn(new)
        heads = [s[0] if len(s) > 1 and s[0] and s[0].strip() == s[0] and len(s[0]) <= LONG else "" for s in split]
        encoded = self.library.encode_batch_fast(heads, add_special_tokens=False)
        out = []
        for text, s, head, first in zip(texts, split, heads, encoded, strict=True):
            try:
                # The first stretch has no space before it. Without it the text goes whole.
                rest = b"".join(map(self.memo.__getitem__, s[1:])) if head else None
            except TypeError:
                rest = None
            if rest is None:
                out.append(self._encode_long(text or ""))
            else:
                out.append(np.concatenate([np.array(first.ids, np.uint32), np.frombuffer(rest, "<u4")]))
        for s in [s for s in new if len(s) > MEMO_CHARS]:
            del self.memo[s]
        return out

    def encode_batch(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Ids of each whole text; a null text has none."""
        if not self.by_stretch:
            return [self._encode_long(t or "") for t in texts]
        cuts = [_halved(t or "") for t in texts]
        leaves = [t[b:e] if t and len(own) > 1 else t for t, own in zip(texts, cuts, strict=True) for b, e in own]
        ids = iter(self._encode_texts(leaves))
        nodes = [[next(ids) for _ in own] for own in cuts]
        self._concatenate(texts, nodes)
        return [own[0] for own in nodes]

    # -- trees over whole texts ------------------------------------------------------------------

    def _concatenate(self, texts: Sequence[str | None], nodes: list[list[np.ndarray]]) -> None:
        """Join the leaves of each text until one is left; all texts' joins of a level are made together."""
        todo = {k: texts[k].encode() for k, own in enumerate(nodes) if len(own) > 1}
        while todo:
            pairs = []
            for k, raw in todo.items():
                ends = np.cumsum([int(self.widths[x].sum()) for x in nodes[k]]).tolist()
                begins = [0, *ends[:-1]]
                pairs += [(raw, begins[n], ends[n], ends[n + 1], nodes[k][n], nodes[k][n + 1]) for n in range(0, len(ends) - 1, 2)]
            joined = iter(self._seams(pairs))
            for k in list(todo):
                own = nodes[k]
                nodes[k] = [next(joined) for _ in range(len(own) // 2)] + own[len(own) // 2 * 2 :]
                if len(nodes[k]) == 1:
                    del todo[k]

    def _seams(self, pairs: list) -> list[np.ndarray]:
        """Join neighbours (text, begin, middle and end in bytes, left and right ids); all windows of a round go to the library together."""
        out: list = [None] * len(pairs)
        width = dict.fromkeys(range(len(pairs)), WINDOW)
        while width:
            spans = {k: (*self._before(pairs[k], w), *self._behind(pairs[k], w)) for k, w in width.items()}
            encoded = self.library.encode_batch_fast([pairs[k][0][b:e].decode() for k, (_, b, _, e) in spans.items()], add_special_tokens=False)
            for (k, (n, b, m, e)), found in zip(spans.items(), encoded, strict=True):
                raw, begin, _, end, left, right = pairs[k]
                ids = np.array(found.ids, np.uint32)
                starts = b + np.concatenate([[0], np.cumsum(self.widths[ids])[:-1]]) if len(ids) else np.zeros(0, np.int64)
                same = min(len(ids), n)
                first = _equal(ids[:same], left[len(left) - n :][:same])
                same = min(len(ids), m)
                last = _equal(ids[::-1][:same], right[:m][::-1][:same])
                on_left = b == begin or any(_parts(raw, int(p)) for p in starts[:first])
                on_right = e == end or any(_parts(raw, int(p)) for p in starts[len(ids) - last :])
                if on_left and on_right:
                    out[k] = np.concatenate([left[: len(left) - n], ids, right[m:]])
                    self.joins += 1
                    del width[k]
                else:
                    width[k] *= 2
        return out

    def _before(self, pair: tuple, w: int) -> tuple[int, int]:
        """How many of the left side's tokens a window takes, ``w`` or some more, and where it begins: at a whole character."""
        raw, begin, middle, _, left, _ = pair
        n = min(w, len(left))
        at = middle - int(self.widths[left[len(left) - n :]].sum())
        while at > begin and raw[at] & 0xC0 == 0x80:
            n += 1
            at -= int(self.widths[left[len(left) - n]])
        return n, at

    def _behind(self, pair: tuple, w: int) -> tuple[int, int]:
        raw, _, middle, end, _, right = pair
        m = min(w, len(right))
        at = middle + int(self.widths[right[:m]].sum())
        while at < end and raw[at] & 0xC0 == 0x80:
            at += int(self.widths[right[m]])
            m += 1
        return m, at

    def as_text(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        return ",".join(map(self.names.__getitem__, ids.tolist())).encode()

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(map(self.pieces.__getitem__, ids.tolist()))
        return raw.decode("utf-8", "replace").encode()


@functools.lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_decode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None
) -> DataFrame:
    """Ids of every whole text and the text decoded from them.

    Returns ``id_col``, ``ids`` (array of int) and ``decoded`` for each row, repeated rows included. A null
    or empty text has no ids and decodes to the empty text.
    """
    import pyarrow as pa

    path = path or default_path()

    def run(batches):
        c = codec(path)
        for batch in bounded(batches, 1):
            ids = c.encode_batch(batch.column(1).to_pylist())
            flat = np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            arrays = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), arrays, pa.array([c.decode(x).decode() for x in ids], pa.string())], ["id", "ids", "decoded"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Token count and SHA-256 digests of the ids and of the decoded text, made where the ids are."""
    import pyarrow as pa

    path = path or default_path()

    def run(batches):
        c = codec(path)
        for batch in bounded(batches, 1):
            ids = c.encode_batch(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(c.as_text(x)).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in ids], pa.string()),
                ],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(
        run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    ).withColumnRenamed("id", id_col)
