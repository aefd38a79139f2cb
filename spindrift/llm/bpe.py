"""Byte-pair encoding by backtracking over Aho-Corasick matches, and decoding by an offset table.

The automaton over all tokens gives, for every byte position, the longest token that ends there.
A chunk is encoded from its right end: take the longest token that ends here, keep it if it is
compatible with the token on its right (the pair, encoded on its own, stays that pair), else try
its longest proper suffix that is a token, else mark the position as a dead end and step back.
Dead ends are marked once, so the work is linear, and the compatible sequence is the one that
merging by rank produces. All distinct chunks of a batch advance together in numpy arrays.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm.common import offsets, ragged, returning_memory

#: Fixed value: the splitting rule of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Text bytes that are encoded at once; longer single texts are encoded alone.
SLICE_BYTES = 1 << 20
#: Pairs kept in the compatibility table before it starts anew.
PAIRS = 1 << 21


def _byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in byte-level vocabularies: printable Latin-1 as itself, the rest from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder for one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        vocab = {token: i for token, i in spec["model"]["vocab"].items()}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        text: list[bytes] = [b""] * size
        for token, i in vocab.items():
            text[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            text[i] = token.encode()
        self.size = size
        self.lengths = np.array([len(t) for t in text], dtype=np.int64)
        self.starts = offsets(self.lengths)
        self.bytes = np.frombuffer(b"".join(text), dtype=np.uint8)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(PATTERN)

        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        #: Order in which tokens come about; single bytes come before all merges.
        self.rank = np.full(size, -1, dtype=np.int64)
        self.rank[made] = np.arange(len(merges))
        self.left, self.right = np.full(size, -1, dtype=np.int64), np.full(size, -1, dtype=np.int64)
        self.left[made], self.right[made] = left, right
        key = left * size + right
        order = np.argsort(key)
        self.merge_key, self.merge_rank = key[order], np.arange(len(merges))[order]
        self.pairs, self.allowed = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
        self._automaton([t for t in text], set(vocab.values()))

    def _automaton(self, text: list[bytes], usable: set[int]) -> None:
        """Dense transitions with failure links filled in, and the longest token ending at each state."""
        child: list[dict[int, int]] = [{}]
        depth, parent, letter, token = [0], [0], [0], [-1]
        for i in sorted(usable):
            node = 0
            for b in text[i]:
                if b not in child[node]:
                    child[node][b] = len(child)
                    child.append({})
                    depth.append(depth[node] + 1)
                    parent.append(node)
                    letter.append(b)
                    token.append(-1)
                node = child[node][b]
            token[node] = i
        inner = np.array([bool(c) for c in child])
        del child
        depth, parent, letter, token = (np.array(x) for x in (depth, parent, letter, token))
        # a state without children moves like its failure link, so only the others have a row
        row = np.cumsum(inner) - 1
        goto = np.zeros((int(inner.sum()), 256), dtype=np.int32)
        fail = np.zeros(len(depth), dtype=np.int64)
        longest = token.astype(np.int32)
        roots = np.flatnonzero(depth == 1)
        goto[0, letter[roots]] = roots
        for d in range(1, int(depth.max()) + 1):
            level = np.flatnonzero(depth == d)
            if d > 1:
                fail[level] = goto[row[fail[parent[level]]], letter[level]]
            longest[level] = np.where(token[level] >= 0, token[level], longest[fail[level]])
            wide = level[inner[level]]
            goto[row[wide]] = goto[row[fail[wide]]]
            narrow = level[~inner[level]]
            row[narrow] = row[fail[narrow]]
            below = np.flatnonzero(depth == d + 1)
            goto[row[parent[below]], letter[below]] = below
        self.goto, self.row, self.longest = goto, row.astype(np.int32), longest
        #: Longest proper suffix of a token that is a token, or -1.
        self.shorter = np.full(self.size, -1, dtype=np.int64)
        ends = np.flatnonzero(token >= 0)
        self.shorter[token[ends]] = np.where(depth[ends] > 1, longest[fail[ends]], -1)

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens is what encoding their joined bytes gives."""
        distinct, back = np.unique(left * self.size + right, return_inverse=True)
        verdict, known = np.empty(len(distinct), dtype=bool), np.zeros(len(distinct), dtype=bool)
        at = np.searchsorted(self.pairs, distinct)
        inside = at < len(self.pairs)
        known[inside] = self.pairs[at[inside]] == distinct[inside]
        verdict[known] = self.allowed[at[known]]
        new = distinct[~known]
        if len(new):
            verdict[~known] = self._judge(new // self.size, new % self.size)
            if len(self.pairs) + len(new) > PAIRS:
                self.pairs, self.allowed, at = self.pairs[:0], self.allowed[:0], np.zeros_like(at)
            self.pairs = np.insert(self.pairs, at[~known], new)
            self.allowed = np.insert(self.allowed, at[~known], verdict[~known])
        return verdict[back]

    def _judge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Undo merges on both sides of the seam, latest first: a merge across the seam that would
        have come before the merge that covers it shows that the pair falls apart."""
        ok = np.ones(len(left), dtype=bool)
        open_ = np.arange(len(left))
        a, b = left.copy(), right.copy()
        # merges before these ranks have happened while a, b were the tokens at the seam
        until = np.full(len(left), np.iinfo(np.int64).max)
        while len(open_):
            key = a * self.size + b
            at = np.minimum(np.searchsorted(self.merge_key, key), len(self.merge_key) - 1)
            crossing = np.where(self.merge_key[at] == key, self.merge_rank[at], np.iinfo(np.int64).max)
            bad = crossing < until
            ok[open_[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            # of two merges the later is undone first; between equal ones the left comes first in time
            undo_a = ra > rb
            until = np.where(undo_a, ra, rb + 1)
            # a left token merges before an equal one on its right, so its bound excludes the rank itself
            done = bad | ((ra < 0) & (rb < 0))
            a = np.where(undo_a, self.right[a], a)
            b = np.where(undo_a, b, self.left[b])
            keep = ~done
            open_, a, b, until = open_[keep], a[keep], b[keep], until[keep]
        return ok

    def encode_chunks(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the chunks ``data[starts[i]:starts[i + 1]]``: flat ids and how many each has."""
        n = len(starts) - 1
        size = np.diff(starts)
        # longest token ending at each byte: all chunks step through the automaton together
        ends_with = np.zeros(len(data), dtype=np.int64)
        order = np.argsort(-size, kind="stable")
        state, first, sizes = np.zeros(n, dtype=np.int32), starts[:-1][order], size[order]
        alive = n
        for step in range(int(sizes[0]) if n else 0):
            alive = int(np.searchsorted(-sizes[:alive], -step, side="left"))
            at = first[:alive] + step
            state[:alive] = self.goto[self.row[state[:alive]], data[at]]
            ends_with[at] = self.longest[state[:alive]]
        # positions count bytes, one more per chunk than bytes so that every end has a place
        base = starts[:-1] + np.arange(n)
        chosen = np.full(len(data) + n, -1, dtype=np.int64)
        came_from = np.full(len(data) + n, -1, dtype=np.int64)
        open_end = np.ones(len(data) + n, dtype=bool)
        who = np.flatnonzero(size > 0)
        pos = size[who].copy()
        token = ends_with[starts[who] + pos - 1]
        while len(who):
            here = base[who] + pos
            start = here - self.lengths[token]
            after = came_from[here]
            right = np.where(after >= 0, chosen[after], -1)
            ok = open_end[start].copy()
            ask = np.flatnonzero(ok & (right >= 0))
            if len(ask):
                ok[ask] = self.compatible(token[ask], right[ask])
            shorter = self.shorter[token]
            back = ~ok & (shorter < 0)
            chosen[here[ok]] = token[ok]
            came_from[start[ok]] = here[ok]
            open_end[here[back]] = False
            pos = np.where(ok, pos - self.lengths[token], np.where(back, after - base[who], pos))
            more = pos > 0
            token = np.where(ok, ends_with[starts[who] + np.maximum(pos, 1) - 1], np.where(back, chosen[np.maximum(after, 0)], shorter))
            who, pos, token = who[more], pos[more], token[more]
        # read each chunk from its left end
        at, counts, out = base.copy(), np.zeros(n, dtype=np.int64), []
        who = np.flatnonzero(size > 0)
        while len(who):
            to = came_from[at[who]]
            out.append((who, chosen[to]))
            counts[who] += 1
            at[who] = to
            who = who[to < base[who] + size[who]]
        ids = np.zeros(int(counts.sum()), dtype=np.int64)
        place = offsets(counts)[:-1]
        for step, (which, tokens) in enumerate(out):
            ids[place[which] + step] = tokens
        return ids, counts

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and how many each has; special tokens in a text become their ids."""
        pieces, of_piece, n_pieces, specials = self._pieces(texts)
        words, n_words = self._words(pieces)
        chunks = words.dictionary.cast(pa.binary())
        ends = np.frombuffer(chunks.buffers()[1], dtype=np.int32)[chunks.offset : chunks.offset + len(chunks) + 1].astype(np.int64)
        data = np.frombuffer(chunks.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
        ids, counts = self.encode_chunks(data, ends - ends[0])
        # words to pieces, pieces to texts: two ragged gathers
        starts = offsets(counts)[:-1]
        of_word = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        word_ids = ids[ragged(starts[of_word], counts[of_word])]
        piece_counts = _sums(counts[of_word], n_words)
        per_piece = piece_counts[of_piece]
        flat = word_ids[ragged(offsets(piece_counts)[:-1][of_piece], per_piece)]
        if len(specials[0]):
            flat = np.insert(flat, offsets(per_piece)[specials[0]], specials[1])
            per_piece[specials[0]] += 1
        return flat, _sums(per_piece, n_pieces)

    def _words(self, pieces: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The words of all pieces one after another, and how many each has.

        Most pieces are letters and the signs behind them, which Arrow cuts as the splitting rule does.
        """
        cut = pc.extract_regex(pieces, _LETTERS_SIGNS)
        plain = cut.is_valid().to_numpy(zero_copy_only=False)
        letters, signs = cut.filter(pa.array(plain)).flatten()
        signed = pc.not_equal(signs, "").to_numpy(zero_copy_only=False)
        found = [self.words.findall(p) for p in pieces.filter(pa.array(~plain)).to_pylist()]
        n_words = np.empty(len(pieces), dtype=np.int64)
        n_words[plain] = 1 + signed
        n_words[~plain] = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        starts = offsets(n_words)[:-1]
        rest = pa.array(list(chain.from_iterable(found)), pa.string())
        words = pa.concat_arrays([letters, signs.filter(pa.array(signed)), rest]).dictionary_encode()
        order = np.concatenate([starts[plain], starts[plain][signed] + 1, ragged(starts[~plain], n_words[~plain])])
        code = np.empty(len(order), dtype=np.int32)
        code[order] = words.indices.to_numpy(zero_copy_only=False)
        return pa.DictionaryArray.from_arrays(pa.array(code), words.dictionary), n_words

    def _pieces(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Cut texts before each single space between two other characters: always a border of words.

        Returns pieces, the piece at each place, the number of places of each text, and the places
        of special tokens (an empty piece each) with their ids.
        """
        column = pa.array(texts, pa.string())
        odd = pc.match_substring_regex(column, _ODD_SPACE)
        for token in self.special:
            odd = pc.or_(odd, pc.match_substring(column, token))
        odd = odd.to_numpy(zero_copy_only=False)
        split = pc.split_pattern(column.filter(pa.array(~odd)), " ")
        coded = split.flatten().dictionary_encode()
        spaced = pc.binary_join_element_wise(" ", coded.dictionary, "")
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n_plain = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        # a text's first piece has no space before it
        firsts = offsets(n_plain)[:-1]
        raw = coded.dictionary.take(pa.array(codes[firsts]))
        codes[firsts] = len(spaced) + np.arange(len(firsts))

        n_odd, extra, at, value = [], [], [], []
        for i in np.flatnonzero(odd):
            before = len(extra)
            for part in self.split_special.split(texts[i]) if self.special else (texts[i],):
                if part in self.special:
                    at.append(len(codes) + len(extra))
                    value.append(self.special[part])
                    extra.append("")
                else:
                    extra += _BORDER.split(part)
            n_odd.append(len(extra) - before)
        codes = np.concatenate([codes, len(spaced) + len(raw) + np.arange(len(extra))])
        pieces = pa.concat_arrays([spaced, raw, pa.array(extra, pa.string())])

        counts = np.zeros(len(texts), dtype=np.int64)
        counts[~odd], counts[odd] = n_plain, n_odd
        starts = np.zeros(len(texts), dtype=np.int64)
        starts[~odd], starts[odd] = firsts, len(codes) - len(extra) + offsets(np.array(n_odd, dtype=np.int64))[:-1]
        order = ragged(starts, counts)
        moved = np.empty(len(codes), dtype=np.int64)
        moved[order] = np.arange(len(codes))
        places = np.sort(moved[at]) if at else np.zeros(0, dtype=np.int64)
        values = np.array(value, dtype=np.int64)[np.argsort(moved[at])] if at else places
        return pieces, codes[order], counts, (places, values)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Bytes of each text: the offset table gives every id's place in the vocabulary's bytes."""
        data = self.bytes[ragged(self.starts[ids], self.lengths[ids])].tobytes()
        ends = offsets(_sums(self.lengths[ids], counts)).tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]


_BORDER = regex.compile(r"(?<=\S)(?= \S)")
#: Letters of ASCII and Latin, perhaps with a space before them, then ASCII signs: at most two words of ``PATTERN``.
_LETTERS_SIGNS = r"^(?P<letters> ?[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+)(?P<signs>[!-/:-@\[-`{-~]*)$"
#: A space beside white space of any kind, for RE2, whose \s is ASCII only.
_ODD_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\pZ] | [\s\x0b\x1c-\x1f\x{85}\pZ]"


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = offsets(values)
    at = offsets(counts)
    return ends[at[1:]] - ends[at[:-1]]


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """One vocabulary per worker process."""
    return Bpe(path)


def slices(texts: list[str | None]):
    """Ranges of consecutive texts of about ``SLICE_BYTES`` together."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= SLICE_BYTES:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _encode(path: str, text_at: int, names: list[str], decode: bool):
    def encode(batches):
        bpe = load(path)
        for b in batches:
            texts = b.column(text_at).to_pylist()
            for first, last in slices(texts):
                ids, counts = bpe.encode_batch([t or "" for t in texts[first:last]])
                data, ends = ids.astype("<u4").tobytes(), (offsets(counts) * 4).tolist()
                columns = [pa.array(counts, pa.int64()), pa.array([data[i:j] for i, j in zip(ends, ends[1:], strict=False)], pa.binary())]
                if decode:
                    columns.append(pa.array([t.decode("utf-8", "replace") for t in bpe.decode(ids, counts)], pa.string()))
                yield pa.RecordBatch.from_arrays([*b.slice(first, last - first).columns, *columns], names=names)

    return returning_memory(encode)


def encode(docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), decode: bool = False) -> DataFrame:
    """Columns ``keep`` of every row with ``n_tokens``, ``ids`` (binary: unsigned 32-bit, little-endian)
    and, if asked for, ``decoded``, the text that the ids stand for.

    One row per input row, no special tokens added. Null and empty texts give no ids. Special
    tokens written out in a text become their ids. Texts are encoded whole, whatever their length;
    rows may repeat and ids be null, as rows don't meet. An empty table gives an empty result.
    ``path`` is the vocabulary file on the workers; ``keep`` must not name a column like a result.
    """
    chosen = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())] + [T.StructField("decoded", T.StringType())] * decode
    schema = T.StructType([*chosen.schema, *added])
    return chosen.mapInArrow(_encode(path, len(keep), schema.names, decode), schema).drop("_text")


def _decode(path: str, ids_at: int, names: list[str]):
    def decode(batches):
        bpe = load(path)
        for b in batches:
            held = [i or b"" for i in b.column(ids_at).to_pylist()]
            ids = np.frombuffer(b"".join(held), dtype="<u4").astype(np.int64)
            texts = bpe.decode(ids, np.array([len(i) // 4 for i in held], dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], names=names)

    return decode


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """All columns and ``decoded``; null ids decode to the empty text, bytes that are not UTF-8 to U+FFFD."""
    schema = T.StructType([*encoded.schema, T.StructField("decoded", T.StringType())])
    return encoded.mapInArrow(_decode(path, encoded.columns.index(ids_col), schema.names), schema)
