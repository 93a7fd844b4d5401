"""BPE encoding and decoding with a public tokenizer's vocabulary, by tree concatenation.

White space always ends a pre-token of such a vocabulary and leaves no token, so the chunks between ASCII white space are
encoded on their own, and each worker remembers short chunks it has seen, up to REMEMBERED bytes. Texts of more than SPLIT characters are halved
until the pieces have LEAF characters or less, and the pieces are rows of their own, encoded in parallel. A cut falls on
white space where there is some near the middle, and is exact as it is. Elsewhere, in long unsplit text, a piece is
encoded with its tokens' places, and the two sides of the cut are joined so: a window around it, from token to token, is encoded
again and grows, until it agrees with the tokens of both sides in AGREE consecutive tokens (ids and places) or has
reached their ends. Byte-pair encodings are right if all neighbouring tokens are, so what lies between the agreements
replaces the tokens at the cut, and the result is that of the whole text.

Null and empty texts have no ids and decode to "". Equal long texts are encoded once; rows that repeat, or share an id, are encoded
alike. ids are little-endian unsigned 32-bit integers in a binary column. An empty table gives no rows; columns are found by position, so names
that clash do no harm. The vocabulary's path is a parameter; every executor must be able to read it. Nothing runs before the result is used.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernal.llm.common import packed, tidied

SPLIT, LEAF = 65_536, 16_384
#: Characters around the middle where white space is looked for.
NEAR = 256
AGREE = 4
#: Tokens on each side that a window starts with; it doubles.
WINDOW = 16
#: Bytes that a worker's remembered chunks take, at most, about; longer chunks than LONGEST are not remembered.
REMEMBERED, LONGEST = 96 << 20, 64
#: Bytes of a remembered chunk's objects without their contents, about.
OBJECTS = 300
#: Rows whose results a worker hands over at a time.
HANDED = 512

_SPACE = re.compile(r"[\x20\x09-\x0D]")
_CHUNK = re.compile(r"[^\x20\x09-\x0D]+")


# The pipeline of a vocabulary with word ends, as its file states it.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

#: What PATTERN matches in lower-cased printable ASCII.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    # Each part as JSON; the whole vocabulary is never turned into Python objects.
    normalizer, split = (json.loads(x.__getstate__()) if x else {} for x in (out.normalizer, out.pre_tokenizer))
    split = (split.get("pretokenizers") or [split])[0]
    added = [t.content for t in out.get_added_tokens_decoder().values()]
    if normalizer.get("normalizers") != NORMALIZERS or split.get("pattern") != {"Regex": PATTERN} or out.decoder or any(_SPACE.search(t) or "<|" not in t for t in added):
        raise ValueError(f"{path}: not a lower-case vocabulary with word ends, for which white space separates")
    out.no_truncation()
    out.no_padding()
    return out


class _Chunks(dict):
    """chunk -> (ids as bytes, tokens decoded, or "" if they aren't wanted).

    Bounded by bytes, whatever the chunks are: what was remembered last and what before have half of them each, and when the
    former is full the latter goes, but for what is asked for again.
    """

    def __init__(self, path: str, decoded: bool = True):
        self.tok = tokenizer(path)
        self.merge = self.tok.model.tokenize
        self.said = [self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size(with_added_tokens=True))] if decoded else None
        self.before: dict[str, tuple[bytes, str]] = {}
        self.bytes = 0

    def __missing__(self, chunk: str) -> tuple[bytes, str]:
        out = self.before.get(chunk) or self.encoded(chunk)
        if len(chunk) <= LONGEST:
            if self.bytes >= REMEMBERED // 2:
                self.before = dict(self)
                self.clear()
                self.bytes = 0
            self.bytes += OBJECTS + 2 * len(chunk) + len(out[0]) + 2 * len(out[1])
            self[chunk] = out
        return out

    def encoded(self, chunk: str) -> tuple[bytes, str]:
        if chunk.isascii() and chunk.isprintable() and "<|" not in chunk:  # bytes are their own letters, and nothing is normalised but case
            ids = [t.id for word in _ASCII.findall(chunk.lower()) for t in self.merge(word)]
        else:
            ids = self.tok.encode(chunk, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes(), " ".join([self.said[i] for i in ids]) if self.said else ""


@lru_cache(maxsize=4)
def _chunks(path: str, decoded: bool = True) -> _Chunks:
    return _Chunks(path, decoded)


def encode_text(text: str, path: str, decoded: bool = True) -> tuple[bytes, str]:
    """(ids, decoded text). Decoding joins tokens by one space, so the chunks' decoded texts are joined so too."""
    got = list(map(_chunks(path, decoded).__getitem__, _CHUNK.findall(text)))
    return b"".join([a for a, _ in got]), " ".join([b for _, b in got if b])


# A piece with its tokens' places: int64 rows of (id, start, end) in the whole text.
def _placed(text: str, start: int, end: int, path: str) -> np.ndarray:
    e = tokenizer(path).encode(text[start:end], add_special_tokens=False)
    at = np.array(e.offsets, "int64").reshape(-1, 2) + start
    return np.concatenate([np.array(e.ids, "int64").reshape(-1, 1), at], axis=1)


def _meet(one: np.ndarray, two: np.ndarray, last: bool) -> tuple[int, int] | None:
    """The first (or last) places (p, q) where AGREE consecutive tokens of one and two are the same; both are sorted by place."""
    at: dict[tuple, list[int]] = {}
    for q in range(len(two) - AGREE + 1):
        at.setdefault(tuple(two[q]), []).append(q)
    order = range(len(one) - AGREE, -1, -1) if last else range(len(one) - AGREE + 1)
    for p in order:
        for q in at.get(tuple(one[p]), ()):
            if (one[p : p + AGREE] == two[q : q + AGREE]).all():
                return p, q
    return None


def join(left: np.ndarray, right: np.ndarray, text: str, start: int, end: int, path: str) -> np.ndarray:
    """The tokens of text[start:end] from those of its two sides."""
    n = WINDOW
    while True:
        i, j = max(0, len(left) - n), min(len(right), n)
        # The first token of the window must not stand inside a character that earlier tokens began.
        whole_left, whole_right = i == 0, j == len(right)
        begin = start if whole_left else int(left[i, 1])
        stop = end if whole_right else int(right[j - 1, 2])
        window = _placed(text, begin, stop, path)
        a = (0, 0) if whole_left else _meet(window, left[i:], last=False)
        # The end of a window that is none of the text changes the tokens of its last word: agree before it.
        b = (len(window), j) if whole_right else _meet(window[: max(0, len(window) - AGREE)], right[:j], last=True)
        if a and b and a[0] <= b[0]:
            return np.concatenate([left[: i + a[1]], window[a[0] : b[0]], right[b[1] :]])
        n *= 2


def cuts(text: str, leaf: int = LEAF, near: int = NEAR) -> list[tuple[int, bool]]:
    """(place, open) of each cut, in order; open: not at white space."""
    out: list[tuple[int, bool]] = []
    todo = [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if b - a <= max(2, leaf):
            continue
        mid = (a + b) // 2
        lo, hi = max(a + 1, mid - near), min(b - 1, mid + near)
        spaces = [m.start() for m in _SPACE.finditer(text, lo, hi)]
        cut = min(spaces, key=lambda x: abs(x - mid)) if spaces else mid
        out.append((cut, not spaces))
        todo += [(a, cut), (cut, b)]
    return sorted(out)


@tidied
def _pieces(batches: Iterator[pd.DataFrame], leaf: int, near: int) -> Iterator[pd.DataFrame]:
    for x in batches:
        for digest, text in zip(x["digest"], x["text"], strict=True):
            at = cuts(text, leaf, near)
            ends = [0, *(c for c, _ in at), len(text)]
            opens = [False, *(o for _, o in at), False]
            yield pd.DataFrame({"digest": digest, "start": ends[:-1], "text": [text[a:b] for a, b in zip(ends, ends[1:], strict=False)], "open_left": opens[:-1], "open_right": opens[1:]})


@tidied
def _encoded_pieces(batches: Iterator[pd.DataFrame], path: str, decode: bool = True) -> Iterator[pd.DataFrame]:
    """tokens: of a piece with an open side, its placed tokens, and its text stays; of others, their ids."""
    for x in batches:
        tokens, decoded = [], []
        for text, start, a, b in zip(x["text"], x["start"], x["open_left"], x["open_right"], strict=True):
            if a or b:
                placed = _placed(text, 0, len(text), path)
                placed[:, 1:] += start
                ids, said = placed.tobytes(), ""
            else:
                ids, said = encode_text(text, path, decode)
            tokens.append(ids)
            decoded.append(said)
        text = x["text"].where(x["open_left"] | x["open_right"], "")
        yield x.assign(tokens=tokens, decoded=decoded, text=text)
    _chunks.cache_clear()


def _joined(pieces: pd.DataFrame, path: str, decode: bool = True) -> pd.DataFrame:
    """The pieces of one text: its ids and decoded text. Stretches of pieces with open cuts are joined as a tree."""
    pieces = pieces.sort_values("start")
    tok, ids, said = tokenizer(path), [], []
    stretch: list[tuple[str, int, np.ndarray]] = []
    for text, start, b, tokens, decoded in zip(pieces["text"], pieces["start"], pieces["open_right"], pieces["tokens"], pieces["decoded"], strict=True):
        if b or stretch:
            stretch.append((text, start, np.frombuffer(tokens, "int64").reshape(-1, 3)))
        else:
            # A piece that is open to the left only ends a stretch, so this one has plain ids.
            ids.append(tokens)
            said.append(decoded)
        if stretch and not b:
            first, whole = stretch[0][1], "".join(t for t, _, _ in stretch)
            parts = [(s - first, s - first + len(t), x - np.array([0, first, first])) for t, s, x in stretch]
            while len(parts) > 1:
                pairs = [(parts[k], parts[k + 1]) for k in range(0, len(parts) - 1, 2)]
                parts = [(l[0], r[1], join(l[2], r[2], whole, l[0], r[1], path)) for l, r in pairs] + (parts[-1:] if len(parts) % 2 else [])
            got = parts[0][2][:, 0]
            ids.append(got.astype("<u4").tobytes())
            said.append(tok.decode(got.tolist(), skip_special_tokens=False) if decode else "")
            stretch = []
    return pd.DataFrame({"digest": [pieces["digest"].iloc[0]], "ids": [b"".join(ids)], "decoded": [" ".join(s for s in said if s)]})


@tidied
def _encoded(batches: Iterator[pa.RecordBatch], path: str, decode: bool) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for k in range(0, whole.num_rows, HANDED):
            b = whole.slice(k, HANDED)
            got = [encode_text(t.as_py(), path, decode) for t in b.column("text")]
            cols = [b.column("id"), pa.array([a for a, _ in got], pa.binary()), pa.array([d for _, d in got], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "ids", "decoded"])
    _chunks.cache_clear()  # the worker idles on, and holds what it remembers


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", split: int = SPLIT, leaf: int = LEAF, near: int = NEAR, decoded: bool = True) -> DataFrame:
    """One row per row of df: id, ids (binary) and, if wanted, decoded."""
    rows = packed(df, id=id_col, text=text_col).select("id", F.coalesce("text", F.lit("")).alias("text"))
    kind = next(f.dataType.simpleString() for f in rows.schema if f.name == "id")
    short = rows.where(F.length("text") <= split).mapInArrow(lambda it: _encoded(it, path, decoded), f"id {kind}, ids binary, decoded string")
    long = rows.where(F.length("text") > split).withColumn("digest", F.unhex(F.sha2("text", 256)))
    pieces = long.select("digest", "text").dropDuplicates(["digest"]).mapInPandas(lambda it: _pieces(it, leaf, near), "digest binary, start int, text string, open_left boolean, open_right boolean")
    pieces = pieces.repartition("digest", "start").mapInPandas(lambda it: _encoded_pieces(it, path, decoded), "digest binary, start int, text string, open_left boolean, open_right boolean, tokens binary, decoded string")
    whole = pieces.groupBy("digest").applyInPandas(lambda x: _joined(x, path, decoded), "digest binary, ids binary, decoded string")
    both = short.unionByName(long.select("id", "digest").join(whole, "digest").select("id", "ids", "decoded"))
    return both if decoded else both.drop("decoded")


def decode(ids: bytes, path: str) -> str:
    """The inverse for one text's ids, special tokens included."""
    return tokenizer(path).decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
