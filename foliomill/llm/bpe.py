"""Byte-level BPE: exact backtracking encoder and offset-table decoder.

Encoding.  The text is cut into pre-tokens; inside a pre-token an Aho-Corasick automaton over
all tokens finds, for every position, the longest token that starts there.  The encoder walks
left to right with the longest token, and accepts it only if the pair it makes with its left
neighbour is one that the merges themselves could leave side by side (the pair-compatibility
table, filled on demand).  A refused token is replaced by its longest proper prefix that is a
token; when none is left, the position is marked dead and the walk steps back.  Each position
dies once at most, so the work is linear in the text.

Decoding gathers byte runs out of one buffer through the offset table of the vocabulary.

Batches.  A unit is a chunk between single spaces, with its leading space.  The pre-token rule
never joins characters across the start of a unit whose chunk begins with a visible character,
so equal units have equal ids wherever they stand.  The distinct units of a batch are encoded
once and dealt out by an index; a text that breaks the condition (runs of white space, special
tokens) is encoded as a whole.
"""

from __future__ import annotations

import functools
import hashlib
import json
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.common import ragged_take, sub_batches, text_or_empty, tokenizer_path, with_fields

#: Unicode White_Space, and the public pre-token rule of byte-level BPE.
WHITE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE_SPACE}\p{{L}}\p{{N}}]+|[{WHITE_SPACE}]+(?=[{WHITE_SPACE}]|\Z)|[{WHITE_SPACE}]+"
DEFAULT_VOCABULARY = "byte_bpe_50k.json"
_RE2_SPACE = "\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_PAIR_BITS = 20
_CACHE_ENTRIES = 400_000
_CACHE_CHARS = 48
_WORD_AND_MARKS = rf"^(?P<word>\pL+|\pN+|)(?P<marks>[^{_RE2_SPACE}\pL\pN]*)$"


def byte_alphabet() -> dict[str, int]:
    """The public printable alphabet of byte-level vocabularies: character -> byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


class BpeCodec:
    """Encoder and decoder for a byte-level vocabulary whose ids follow the merge order."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        size = max([*vocab.values(), *self.special.values()]) + 1
        tokens = [b""] * size
        for token, i in vocab.items():
            tokens[i] = bytes(alphabet[c] for c in token)
        for token, i in self.special.items():
            tokens[i] = token.encode()
        self.left, self.right = list(range(size)), list(range(size))
        self.merged: dict[int, int] = {}
        last = -1
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            whole, a, b = vocab[a + b], vocab[a], vocab[b]
            if whole <= last or whole <= max(a, b):
                raise ValueError("the ids of this vocabulary don't follow its merges")
            last = whole
            self.left[whole], self.right[whole] = a, b
            self.merged[a << _PAIR_BITS | b] = whole
        self.lengths = [len(t) for t in tokens]
        self.table = pa.array(tokens, pa.binary())  # buffer and offsets: the decoder's offset table
        self.decimals = pa.array([str(i) for i in range(size)], pa.string())
        self.automaton = ahocorasick.Automaton()
        by_bytes = {}
        for token, i in vocab.items():
            by_bytes[tokens[i]] = i
            self.automaton.add_word(tokens[i].decode("latin-1"), (i, len(tokens[i])))
        self.automaton.make_automaton()
        self.shorter = [-1] * size
        for t, i in by_bytes.items():
            for n in range(len(t) - 1, 0, -1):
                if (j := by_bytes.get(t[:n])) is not None:
                    self.shorter[i] = j
                    break
        self.compatible: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self._pre = regex.compile(PRE_TOKEN)
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _compatible(self, a: int, b: int) -> bool:
        """Could the merges leave a and b side by side?

        Undo merges around the seam, latest first; if at some point the two tokens at the seam
        have a merge that comes before the one just undone, the merges would have taken it.
        """
        key = a << _PAIR_BITS | b
        known = self.compatible.get(key)
        if known is not None:
            return known
        merged, left, right = self.merged, self.left, self.right
        limit, result = 1 << 40, True
        while True:
            whole = merged.get(a << _PAIR_BITS | b)
            if whole is not None and whole < limit:
                result = False
                break
            split_a, split_b = left[a] != a, left[b] != b
            if split_a and (not split_b or a > b):
                limit, a = a, right[a]
            elif split_b:
                # a merge further left in the text wins a tie, so the seam may also use this rank
                limit, b = b + 1, left[b]
            else:
                break
        if len(self.compatible) > 2_000_000:
            self.compatible.clear()
        self.compatible[key] = result
        return result

    def _longest(self, piece: str) -> list[int]:
        """The longest token that starts at each position, by one scan of the automaton."""
        longest = [-1] * len(piece)
        for end, (token, length) in self.automaton.iter(piece):
            longest[end - length + 1] = token
        return longest

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one pre-token, given as its bytes in Latin-1."""
        n, longest = len(piece), self._longest(piece)
        lengths, shorter, pairs = self.lengths, self.shorter, self.compatible
        out: list[int] = []
        dead: set[int] = set()
        at, before, token = 0, -1, longest[0]
        while True:
            end = at + lengths[token]
            fits = end not in dead
            if fits and before >= 0:
                fits = pairs.get(before << _PAIR_BITS | token)
                if fits is None:
                    fits = self._compatible(before, token)
            if fits:
                out.append(token)
                if end == n:
                    return out
                at, before = end, token
                token = longest[at]
                continue
            token = shorter[token]
            if token < 0:
                dead.add(at)
                token = out.pop()
                at -= lengths[token]
                before = out[-1] if out else -1

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; special tokens in it become their own ids."""
        parts = self._special.split(text) if self._special else [text]
        out: list[int] = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            else:
                out += self.encode_plain(part)
        return out

    def encode_plain(self, text: str) -> list[int]:
        """Ids of a whole text in which special tokens are text like any other."""
        out: list[int] = []
        for piece in self._pre.findall(text):
            out += self.encode_piece(piece.encode("utf-8").decode("latin-1"))
        return out

    def _pieces(self, units: list[str], single: list[bool]) -> list[bytes]:
        """The ids of each text as bytes of int32, kept for later batches if short.

        single: whether a text is one pre-token.
        """
        cache, piece, whole = self.cache, self.encode_piece, self.encode
        out = list(map(cache.get, units))
        for i, got in enumerate(out):
            if got is None:
                unit = units[i]
                ids = piece(unit if unit.isascii() else unit.encode().decode("latin-1")) if single[i] else whole(unit)
                out[i] = got = array("i", ids).tobytes()
                if len(unit) <= _CACHE_CHARS:
                    if len(cache) >= _CACHE_ENTRIES:
                        cache.clear()
                    cache[unit] = got
        return out

    def _tables(self, chunks: pa.Array, lead: str) -> tuple[np.ndarray, list[bytes]]:
        """Two pieces for each distinct chunk, and the pieces' ids: a word with its lead and the
        marks after it, or else the whole chunk and nothing."""
        found = pc.extract_regex(chunks, _WORD_AND_MARKS)
        plain = found.is_valid().to_numpy(zero_copy_only=False)
        word, marks = pc.struct_field(found, "word"), pc.struct_field(found, "marks")
        bare = plain & (pc.binary_length(word).fill_null(0).to_numpy(zero_copy_only=False) == 0)
        plain &= ~bare
        first = pc.if_else(pa.array(plain), word, chunks).dictionary_encode()
        second = pc.if_else(pa.array(plain), marks, pa.scalar("")).dictionary_encode()
        a, b = first.dictionary.to_pylist(), second.dictionary.to_pylist()
        single = np.zeros(len(a), bool)  # the same text is either a word in every chunk or in none
        single[first.indices.to_numpy()[plain]] = True
        pieces = self._pieces([lead + x for x in a], single.tolist()) + self._pieces(b, [False] * len(b))
        pairs = np.empty((len(chunks), 2), np.int64)
        pairs[:, 0] = first.indices.to_numpy()
        pairs[:, 1] = second.indices.to_numpy()
        pairs[:, 1] += len(a)
        return pairs, pieces

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat int32 ids of all texts, and int64 offsets of each text; null counts as empty."""
        n = len(texts)
        if n == 0:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        texts = pc.fill_null(texts.cast(pa.string()), "")
        chunks = pc.split_pattern(texts, " ")
        offsets = chunks.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        values = chunks.flatten()
        first = np.zeros(len(values), bool)
        first[offsets[:-1]] = True
        doc = np.repeat(np.arange(n), np.diff(offsets))
        coded = values.dictionary_encode()
        codes, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        blank = pc.match_substring_regex(words, rf"^([{_RE2_SPACE}]|$)").to_numpy(zero_copy_only=False)
        odd = np.zeros(n, bool)
        odd[doc[blank[codes] & ~first]] = True
        for special in self.special:
            odd |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        pairs, pieces = self._tables(words, " ")
        opening = values.take(pa.array(offsets[:-1])).dictionary_encode()
        more, more_pieces = self._tables(opening.dictionary, "")
        index = pairs[codes]
        index[offsets[:-1]] = more[opening.indices.to_numpy()] + len(pieces)
        pieces += more_pieces
        if odd.any():
            even, whole = ~odd[doc], np.flatnonzero(odd)
            at = len(pieces) + np.arange(len(whole))
            pieces += [np.array(self.encode(texts[int(i)].as_py()), np.int32).tobytes() for i in whole]
            pieces.append(b"")
            owner = np.concatenate([doc[even], whole])
            index = np.concatenate([index[even], np.stack([at, np.full(len(at), len(pieces) - 1)], 1)])
            order = np.argsort(owner, kind="stable")
            index, doc = index[order], owner[order]
        index = index.reshape(-1)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        flat, _ = ragged_take(np.frombuffer(b"".join(pieces), np.int32), np.concatenate([[0], np.cumsum(lengths)]), index)
        per_doc = np.bincount(doc, weights=lengths[index].reshape(-1, 2).sum(1), minlength=n).astype(np.int64)
        return flat, np.concatenate([[0], np.cumsum(per_doc)])

    def decode_batch(self, flat: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """UTF-8 of each text; broken sequences become U+FFFD."""
        taken = self.table.take(pa.array(flat, pa.int32()))
        if len(taken) == 0:
            return [b""] * (len(offsets) - 1)
        byte_offsets = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1, taken.offset * 4)
        data = memoryview(taken.buffers()[2])
        edges = byte_offsets[offsets].tolist()
        out = []
        for a, b in zip(edges[:-1], edges[1:]):
            raw = bytes(data[a:b])
            try:
                raw.decode()
            except UnicodeDecodeError:
                raw = raw.decode(errors="replace").encode()
            out.append(raw)
        return out

    def decode(self, ids: list[int]) -> str:
        return self.decode_batch(np.array(ids, np.int32), np.array([0, len(ids)]))[0].decode()

    def decimal_lists(self, flat: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Each text's ids as decimal numbers joined by commas."""
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), self.decimals.take(pa.array(flat, pa.int32())))
        return pc.binary_join(lists, ",").to_pylist()


@functools.lru_cache(maxsize=2)
def codec(path: str) -> BpeCodec:
    """One codec for each worker process and vocabulary."""
    return BpeCodec(path)


def encode(df: DataFrame, text_col: str = "text", out_col: str = "ids", path: str | None = None) -> DataFrame:
    """Add `out_col`, the array of token ids of each whole text; null texts give an empty array.

    All columns of `df` stay as they are; a column that has the output's name is replaced.
    """
    path = path or tokenizer_path(DEFAULT_VOCABULARY)

    def run(batches):
        for whole in batches:
            for batch in sub_batches(whole, whole.num_columns - 1):
                flat, offsets = codec(path).encode_batch(batch.column(batch.num_columns - 1))
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], [*kept, out_col])

    kept = [c for c in df.columns if c != out_col]
    text = df.select(*[F.col(f"`{c}`") for c in kept], text_or_empty(F.col(f"`{text_col}`")).alias("__bpe_text"))
    schema = with_fields(df.drop(out_col).schema, f"`{out_col}` array<int>")
    return text.mapInArrow(run, schema)


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", path: str | None = None) -> DataFrame:
    """Add `out_col`, the text of each array of ids; null arrays give the empty text."""
    path = path or tokenizer_path(DEFAULT_VOCABULARY)
    kept = [c for c in df.columns if c != out_col]

    def run(batches):
        for batch in batches:
            ids = batch.column(kept.index(ids_col))
            lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
            texts = codec(path).decode_batch(ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32), offsets)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([t.decode() for t in texts], pa.string())], [*kept, out_col])

    return df.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, with_fields(df.drop(out_col).schema, f"`{out_col}` string"))


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encode and decode every text, and return the digests of both.

    Gives id_col, n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256.  Null
    texts count as empty; ids may be null or repeated, each row is answered for itself.
    Texts of any length are encoded whole, repeated rows each for itself; an empty table gives an
    empty result.
    """
    path = path or tokenizer_path(DEFAULT_VOCABULARY)

    def run(batches):
        for whole in batches:
            for batch in sub_batches(whole, 1, 8 << 20):
                c = codec(path)
                flat, offsets = c.encode_batch(batch.column(1))
                ids = [hashlib.sha256(s.encode()).hexdigest() for s in c.decimal_lists(flat, offsets)]
                texts = [hashlib.sha256(t).hexdigest() for t in c.decode_batch(flat, offsets)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names)

    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
    source = df.select(F.col(f"`{id_col}`"), text_or_empty(F.col(f"`{text_col}`")).alias("__bpe_text"))
    schema = with_fields(source.select(id_col).schema, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return source.mapInArrow(run, schema)
