"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

A text becomes `▁` + text with spaces as `▁`, and is cut wherever no vocabulary piece holds the
two neighbouring characters, so no merge crosses a cut. The symbols of all distinct words of a
batch lie in one flat array. A round finds the best-ranked pair of each word by a segmented
minimum, merges all its leftmost non-overlapping occurrences at once and closes the gaps; words
without a mergeable pair leave the array. What is left of unknown characters becomes byte pieces.

One merge at a time is the reference order. Several at once give the same unless a merge makes a
pair as good as its own or better; such a word merges its leftmost pair only in that round.

Defined cases: null and empty texts have no ids and decode to the empty text; rows are
independent, so repeated rows and equal ids do no harm; texts of any length are cut into pieces
at spaces, so memory is bounded by one batch; columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vigil.llm import common

SPACE = "▁"
NONE = np.int32(2**31 - 1)
#: Characters encoded at once, and characters of words remembered between batches (memory bounds only).
CHUNK, REMEMBER = 1_000_000, 1_500_000


class _Table:
    """Open-addressed hash table from int64 keys to positions, looked up for whole arrays."""

    def __init__(self, keys: list[int]):
        self.bits = max(4, len(keys).bit_length() + 3)
        self.mask = (1 << self.bits) - 1
        self.keys, self.at = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, -1, np.int32)
        slots = self._slot(np.array(keys, np.int64)).tolist()
        taken: set[int] = set()
        for k, (key, slot) in enumerate(zip(keys, slots)):
            while slot in taken:
                slot = (slot + 1) & self.mask
            taken.add(slot)
            self.keys[slot], self.at[slot] = key, k

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, -1 where it is not there."""
        slot = self._slot(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.at[slot], -1)
        open_ = np.flatnonzero((seen != keys) & (seen != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            seen = self.keys[slot[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.at[slot[open_[hit]]]
            open_ = open_[~hit & (seen != -1)]
        return out


class Codec:
    """The tables of a BPE model, and the encoder and decoder over flat arrays."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(size)]
        if any(model.is_unused(i) for i in range(size)):
            raise ValueError("models with unused pieces are not supported")
        self.size = size
        normal = {p: i for i, p in enumerate(pieces) if not special[i]}
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("pieces with an inner space are not supported")
        if model.encode("a  a ") != model.encode("a  a ", add_bos=False) or model.decode(model.encode(" a  a ")) != " a  a ":
            raise ValueError("only models that keep all spaces are supported")
        # Characters that occur only inside longer pieces get ids behind the vocabulary.
        chars = sorted({c for p in normal for c in p} - set(normal))
        symbols = normal | {c: size + k for k, c in enumerate(chars)}
        self.char_code = np.array(sorted(ord(c) for c in symbols if len(c) == 1), np.uint32)
        self.char_id = np.array([symbols[chr(c)] for c in self.char_code], np.int32)
        self.width = np.int64(size + len(chars) + 1)
        order = {p: r for r, p in enumerate(sorted(normal, key=lambda p: -model.get_score(normal[p])))}
        ranks = sorted({model.get_score(normal[p]) for p in normal}, reverse=True)
        by_score = {s: r for r, s in enumerate(ranks)}
        pairs: dict[int, tuple[int, int]] = {}
        joins: set[int] = set()
        for p in order:
            for cut in range(1, len(p)):
                left, right = symbols.get(p[:cut]), symbols.get(p[cut:])
                if left is not None and right is not None:
                    pairs[left * int(self.width) + right] = (by_score[model.get_score(normal[p])], normal[p])
                joins.add((ord(p[cut - 1]) << 21) | ord(p[cut]))
        # the last entry stands for pairs that make no piece
        self.pairs = _Table(list(pairs))
        self.pair_rank = np.array([r for r, _ in pairs.values()] + [NONE], np.int32)
        self.pair_id = np.array([p for _, p in pairs.values()] + [-1], np.int32)
        self.joins = _Table(list(joins))
        self.byte_id = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        # Decoding: the bytes of each id, and its decimal digits for digests.
        surface = [b"" if model.is_control(i) else bytes([int(p[3:5], 16)]) if model.is_byte(i) else " ⁇ ".encode() if model.is_unknown(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.surface, self.surface_at = _blob(surface)
        self.digits, self.digits_at = _blob([b"%d," % i for i in range(size)])
        self.word = re.compile(f"{self._space_block(pieces)}{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.forget()

    def forget(self) -> None:
        """Drop the words remembered."""
        self.known: dict[str, int] = {}
        self.held = 0
        self.store, self.store_at = np.empty(0, np.int32), np.zeros(1, np.int64)

    def _space_block(self, pieces: list[str]) -> str:
        """A pattern that takes whole blocks off a long run of spaces, where blocks don't influence the rest.

        Pieces of spaces may share one score, and then merge strictly from the left, one per round.
        """
        longest = max((len(p) for p in pieces if p and not p.strip(SPACE)), default=1)
        ids = lambda n: self.encode_words([SPACE * n])[0].tolist()
        block = ids(longest)
        if any(ids(q * longest + r) != block * q + ids(r) for q in (1, 2, 3) for r in range(longest)):
            return ""
        return f"{SPACE}{{{3 * longest}}}(?={SPACE}{{{longest + 1}}})|"

    # -- encoding ---------------------------------------------------------------

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) * self.width + right
        key[(left < 0) | (right < 0)] = -2
        at = self.pairs.find(key)
        return self.pair_rank[at], self.pair_id[at]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of words in which spaces are already marked, and where each word begins."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(code):
            return np.empty(0, np.int32), np.zeros(len(words) + 1, np.int64)
        at = np.minimum(np.searchsorted(self.char_code, code), len(self.char_code) - 1)
        sym = np.where(self.char_code[at] == code, self.char_id[at], -1).astype(np.int32)
        first = np.zeros(len(code), bool)
        word_at = np.concatenate([[0], np.cumsum(lengths)])
        first[word_at[:-1][lengths > 0]] = True
        near = (code[:-1].astype(np.int64) << 21) | code[1:]
        first[1:] |= self.joins.find(near) < 0
        out = self._merge(sym, first)  # position of each symbol left, and the symbol
        return self._spell(out[0], out[1], code, word_at)

    def _merge(self, sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pos = np.arange(len(sym))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            seg_at = np.flatnonzero(first)
            seg = np.cumsum(first) - 1
            rank, merged = np.full(len(sym), NONE, np.int32), np.full(len(sym), -1, np.int32)
            inner = np.flatnonzero(~first[1:])
            rank[inner], merged[inner] = self._ranks(sym[inner], sym[inner + 1])
            best = np.minimum.reduceat(rank, seg_at)
            over = best == NONE
            if over.any():
                gone = over[seg]
                done.append((pos[gone], sym[gone]))
                stay = ~gone
                sym, pos, first, rank, merged, seg = (x[stay] for x in (sym, pos, first, rank, merged, seg))
                if not len(sym):
                    break
            take = rank == best[seg]
            hit = np.flatnonzero(take)
            # of overlapping occurrences every second one is merged, from the left
            run = np.concatenate([[True], (np.diff(hit) != 1) | (seg[hit[1:]] != seg[hit[:-1]])])
            began = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - began) % 2 == 0]
            hit = self._safe(hit, sym, seg, first, merged, best)
            sym = sym.copy()
            sym[hit] = merged[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, pos, first = sym[keep], pos[keep], first[keep]
        if not done:
            return pos, sym
        pos, sym = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(pos, kind="stable")
        return pos[order], sym[order]

    def _safe(self, hit, sym, seg, first, merged, best) -> np.ndarray:
        """Without the later merges of a word in which one of the merges makes a pair as good or better."""
        owner = seg[hit]
        leftmost = np.concatenate([[True], owner[1:] != owner[:-1]])
        alone = leftmost & np.concatenate([owner[1:] != owner[:-1], [True]])
        if alone.all():
            return hit
        new = merged[hit]
        after = sym.copy()
        after[hit] = new
        # left neighbour as it is once the merges before it are done
        back = np.where(hit > 0, hit - 1, 0)
        swallowed = np.zeros(len(sym), bool)
        swallowed[hit + 1] = True
        back = np.where(swallowed[back] & (hit > 1), hit - 2, back)
        same = (hit > 0) & (seg[back] == owner) & ~first[hit]
        left = np.where(same, after[back], -1)
        ahead = np.minimum(hit + 2, len(sym) - 1)
        right = np.where((hit + 2 < len(sym)) & (seg[ahead] == owner), sym[ahead], -1)
        limit = best[owner]
        bad = (self._ranks(left, new)[0] <= limit) | (self._ranks(new, right)[0] <= limit)
        if not bad.any():
            return hit
        unsafe = np.isin(owner, owner[bad])
        return hit[leftmost | ~unsafe]

    def _spell(self, pos, sym, code, word_at) -> tuple[np.ndarray, np.ndarray]:
        """Symbols as ids: what is not in the vocabulary becomes the ids of its bytes."""
        raw = (sym < 0) | (sym >= self.size)
        count = np.ones(len(sym), np.int64)
        if raw.any():
            utf8 = [chr(c).encode("utf-8", "surrogatepass") for c in code[pos[raw]].tolist()]
            count[raw] = np.fromiter(map(len, utf8), np.int64, len(utf8))
        ends = np.cumsum(count)
        ids = np.repeat(sym, count)
        if raw.any():
            ids[np.repeat(raw, count)] = self.byte_id[np.frombuffer(b"".join(utf8), np.uint8)]
        first_symbol = np.searchsorted(pos, word_at)
        return ids, np.concatenate([[0], ends])[first_symbol]

    def _learn(self, words: list[str]) -> None:
        base = len(self.store_at) - 1
        ids, at = self.encode_words(words)
        self.known.update((w, base + k) for k, w in enumerate(words))
        self.held += sum(map(len, words))
        self.store = np.concatenate([self.store, ids])
        self.store_at = np.concatenate([self.store_at, at[1:] + self.store_at[-1]])

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of texts in which spaces are already marked, and where each text begins."""
        by_text = [self.word.findall(t) for t in texts]
        words = list(itertools.chain.from_iterable(by_text))
        distinct = set(words)
        fresh = [w for w in distinct if w not in self.known]
        if self.held + sum(map(len, fresh)) > REMEMBER:
            self.forget()
            fresh = list(distinct)
        if fresh:
            self._learn(fresh)
        index = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        ends = np.concatenate([[0], np.cumsum(self.store_at[index + 1] - self.store_at[index])])
        word_at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, by_text), np.int64, len(by_text)))])
        return _gather(self.store, self.store_at, index), ends[word_at]

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of one text."""
        parts = [self.encode_all([p])[0] for p in _parts(text)] if text else []
        return np.concatenate(parts) if parts else np.empty(0, np.int32)

    def stream(self, texts: Iterable[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) for texts in order; a long text comes in several parts, an empty one in none."""
        rows: list[int] = []
        waiting: list[str] = []
        held = 0
        for row, text in enumerate(texts):
            for part in _parts(text) if text else ():
                rows.append(row)
                waiting.append(part)
                held += len(part)
                if held >= CHUNK:
                    yield from self._release(rows, waiting)
                    rows, waiting, held = [], [], 0
        yield from self._release(rows, waiting)

    def _release(self, rows: list[int], waiting: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        if rows:
            ids, at = self.encode_all(waiting)
            for k, row in enumerate(rows):
                yield row, ids[at[k] : at[k + 1]]

    # -- decoding ---------------------------------------------------------------

    def decode(self, ids: np.ndarray, first: bool = True) -> bytes:
        """UTF-8 of ids; at the beginning of a text (`first`) one leading space is the added one."""
        out = _gather(self.surface, self.surface_at, ids).tobytes()
        return out[1:] if first and out[:1] == b" " else out

    def decimal(self, ids: np.ndarray) -> bytes:
        """Each id in decimal digits with a comma behind."""
        return _gather(self.digits, self.digits_at, ids).tobytes()


def _blob(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(values), np.uint8), np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int64)


def _gather(flat: np.ndarray, at: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The slices flat[at[i]:at[i + 1]] for all i of `index`, one after the other."""
    start, count = at[index], at[index + 1] - at[index]
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start - (ends - count), count) + np.arange(total)]


def _parts(text: str) -> Iterator[str]:
    """The marked text in parts of about CHUNK characters, cut before a space that follows something else."""
    marked = SPACE + text.replace(" ", SPACE)
    at = 0
    while len(marked) - at > CHUNK:
        cut = marked.find(SPACE, at + CHUNK)
        while cut > 0 and marked[cut - 1] == SPACE:
            cut = marked.find(SPACE, cut + 1)
        if cut < 0:
            break
        yield marked[at:cut]
        at = cut
    yield marked[at:]


_CODECS: dict[str, Codec] = {}


def codec(model_file: str) -> Codec:
    if model_file not in _CODECS:
        _CODECS[model_file] = Codec(model_file)
    return _CODECS[model_file]


def _lean(run):
    """`run` with record batches' memory and remembered words given back at the end of a partition."""
    return common.returning(run, lambda: [c.forget() for c in _CODECS.values()])


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>: the ids of each whole text, without begin or end ids."""

    def run(batches):
        tool = codec(model_file)
        for batch in batches:
            counts, parts = np.zeros(batch.num_rows, np.int64), [np.empty(0, np.int32)]
            for row, ids in tool.stream(x.as_py() for x in batch.column(1)):
                counts[row] += len(ids)
                parts.append(ids)
            at = np.concatenate([[0], np.cumsum(counts)])
            ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(parts), pa.int32()))
            yield pa.record_batch([batch.column(0), ids], ["doc_id", "ids"])

    return common.bounded(common.id_text(docs, id_col, text_col)).mapInArrow(_lean(run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """doc_id, text: the texts of the ids that `encode` returns (null ids: the empty text)."""

    def run(batches):
        tool = codec(model_file)
        for batch in batches:
            rows = [tool.decode(np.asarray(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(rows, pa.string())], ["doc_id", "text"])

    return common.bounded(encoded.select("doc_id", "ids")).mapInArrow(_lean(run), "doc_id long, text string")


def digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text the number of ids, the digest of the ids and that of the text decoded from them."""

    def run(batches):
        tool = codec(model_file)
        for batch in batches:
            n = batch.num_rows
            counts, of_ids, of_texts = [0] * n, [hashlib.sha256() for _ in range(n)], [hashlib.sha256() for _ in range(n)]
            for row, ids in tool.stream(x.as_py() for x in batch.column(1)):
                of_ids[row].update(b"," * bool(counts[row]) + tool.decimal(ids)[:-1])
                of_texts[row].update(tool.decode(ids, first=not counts[row]))
                counts[row] += len(ids)
            of_ids, of_texts = ([x.hexdigest() for x in of] for of in (of_ids, of_texts))
            yield pa.record_batch(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_texts)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return common.bounded(common.id_text(docs, id_col, text_col)).mapInArrow(
        _lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def tokenised(docs: DataFrame, model_file: str, text_col: str = "text") -> DataFrame:
    """`docs` with `ids`, `n_tokens` and `decodes` (the ids give the text back) behind its columns.

    Columns of `docs` with one of these names are replaced.
    """
    added = {"ids": "array<int>", "n_tokens": "long", "decodes": "boolean"}
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c not in added])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches):
        tool = codec(model_file)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            counts, parts = np.zeros(batch.num_rows, np.int64), [np.empty(0, np.int32)]
            back: list[list[bytes]] = [[] for _ in range(batch.num_rows)]
            for row, ids in tool.stream(x.as_py() for x in texts):
                back[row].append(tool.decode(ids, first=not counts[row]))
                counts[row] += len(ids)
                parts.append(ids)
            at = np.concatenate([[0], np.cumsum(counts)])
            ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(parts), pa.int32()))
            same = [b"".join(b) == (t.as_py() or "").encode("utf-8", "surrogatepass") for b, t in zip(back, texts)]
            yield pa.record_batch([*batch.columns, ids, pa.array(counts), pa.array(same)], [*batch.schema.names, *added])

    return common.bounded(docs).mapInArrow(_lean(run), ", ".join([schema, *[f"{n} {t}" for n, t in added.items()]]))
