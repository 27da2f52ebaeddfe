"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text becomes words that no piece of the vocabulary crosses. The symbols of
all words lie in one flat array. A round finds the best-ranked neighbouring
pair of every word by a segmented minimum, merges the leftmost such pair in all
words at once, and compacts the array; words without a pair leave. This is the
order in which a priority queue would merge, so the ids are those of the
library. Equal words are encoded once per task (a bounded table).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowloom.llm.common import chunks, map_batches

SPACE = "▁"
NONE = np.int64(1 << 30)
# Words longer than this merge all equal pairs of a round where that is safe.
LONG_WORD = 48
KNOWN_WORDS = 900_000


class PieceModel:
    """Vocabulary, merge ranks and the two directions."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.end = sp.eos_id()
        ids, self.bytes_of, self.byte_ids = {}, [], {}
        for i, name in enumerate(names):
            if sp.is_byte(i):
                value = int(name[3:5], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.bytes_of.append(" ⁇ ".encode() if sp.is_unknown(i) else b"")
            else:
                ids[name] = i
                self.bytes_of.append(name.replace(SPACE, " ").encode())
        self.starts_with_space = np.array([p in ids and p.startswith(SPACE) for p in names])
        # Characters that only occur inside longer pieces get ids of their own;
        # left unmerged they fall back to bytes, like any unknown character.
        self.symbols = dict(ids)
        for name in ids:
            for c in name:
                self.symbols.setdefault(c, n + len(self.symbols) - len(ids))
        self.n, self.width = n, n + len(self.symbols) - len(ids) + 1
        self.unknown = self.width - 1
        self.lengths = [len(p) for p in names]
        self.by_code = np.full(0x110000, self.unknown, np.int64)
        for c, i in self.symbols.items():
            if len(c) == 1:
                self.by_code[ord(c)] = i
        score = {name: sp.get_score(i) for name, i in ids.items()}
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        pairs = {}
        for name, i in ids.items():
            for cut in range(1, len(name)):
                left, right = self.symbols.get(name[:cut]), self.symbols.get(name[cut:])
                if left is not None and right is not None:
                    pairs[left * self.width + right] = (order[score[name]], i)
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], dtype=np.int64)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], dtype=np.int64)
        self.neighbours = {name[i:i + 2] for name in ids for i in range(len(name) - 1)}
        self.word = re.compile(self._word_pattern(), re.S)
        self.decimal = [str(i).encode() for i in range(n)]
        self.known: dict[str, bytes] = {}

    def _word_pattern(self) -> str:
        """Words end where a letter meets something else, and at line ends, as
        far as no piece of the vocabulary crosses such a place."""
        letter, joined = re.compile(r"[^\W\d_]"), set()
        while True:
            more = {a for a, b in self.neighbours if letter.match(a) and a not in joined and (not letter.match(b) or b in joined)}
            if not more:
                break
            joined |= more
        some = "".join(map(re.escape, sorted(joined)))
        inside = rf"[^\W\d_{some}]"
        if any(b == SPACE != a for a, b in self.neighbours) or any("\n" in p for p in self.neighbours):
            return rf"[\W\d_{some}]*{inside}+|[\W\d_{some}]+"
        outside = rf"(?:[^\w\n{SPACE}]|[\d_{some}])"
        return rf"{SPACE}+{inside}+|{SPACE}+{outside}*{inside}*|{outside}+{inside}*|{inside}+|\n"

    # -- encoding ---------------------------------------------------------

    def _ranked(self, syms: np.ndarray, word: np.ndarray):
        """Rank and merge index of every neighbouring pair; NONE where there is none."""
        key = syms[:-1] * self.width + syms[1:]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (word[:-1] == word[1:])
        return np.where(hit, self.ranks[at], NONE), at

    def _merge(self, syms, word, take, at):
        """Merge the marked pairs; they do not overlap."""
        syms = syms.copy()
        left = np.flatnonzero(take)
        syms[left] = self.merged[at[left]]
        keep = np.ones(len(syms), bool)
        keep[left + 1] = False
        return syms[keep], word[keep]

    def merge_words(self, syms: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge until no word has a pair left; ``word`` is non-decreasing."""
        done_s, done_w = [], []
        rank, at = self._ranked(np.r_[syms, 0], np.r_[word, -1])
        while len(syms):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            # Rank and place in one number: the minimum is the leftmost best pair.
            best = np.minimum.reduceat((rank << 32) | np.arange(len(rank)), starts)
            has = (best >> 32) < NONE
            rest = np.repeat(~has, np.diff(np.r_[starts, len(syms)]))
            done_s.append(syms[rest])
            done_w.append(word[rest])
            left = best[has] & 0xFFFFFFFF
            if not len(left):
                break
            syms[left] = self.merged[at[left]]
            keep = ~rest
            keep[left + 1] = False
            # Only the pairs on both sides of a merged symbol are new.
            place = np.cumsum(keep) - 1
            syms, word, rank, at = syms[keep], word[keep], rank[keep], at[keep]
            here = place[left]
            fresh = np.concatenate([here, here[here > 0] - 1])
            after = np.minimum(fresh + 1, len(syms) - 1)
            key = syms[fresh] * self.width + syms[after]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[found] == key) & (word[fresh] == word[after]) & (after > fresh)
            rank[fresh] = np.where(hit, self.ranks[found], NONE)
            at[fresh] = found
        s, w = np.concatenate(done_s), np.concatenate(done_w)
        order = np.argsort(w, kind="stable")
        return s[order], w[order]

    def merge_long(self, syms: np.ndarray) -> np.ndarray:
        """One long word: all occurrences of the best pair merge in a round,
        unless that makes a pair which a queue would have taken in between."""
        word = np.zeros(len(syms), np.int8)
        while len(syms) > 1:
            rank, at = self._ranked(syms, word[:len(syms)])
            best = rank.min()
            if best == NONE:
                break
            hit = rank == best
            place = np.arange(len(hit))
            run_start = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], place, -1))
            take = hit & ((place - run_start) % 2 == 0)
            after, _ = self._merge(syms, word[:len(syms)], np.r_[take, False], at)
            if take.sum() > 1 and len(after) > 1 and self._ranked(after, word[:len(after)])[0].min() <= best:
                take[np.argmax(take) + 1:] = False
                after, _ = self._merge(syms, word[:len(syms)], np.r_[take, False], at)
            syms = after
        return syms

    def _spell(self, text: str) -> np.ndarray:
        """Symbols of single characters, through a table over code points."""
        return self.by_code[np.frombuffer(text.encode("utf-32-le"), np.uint32)]

    def _ids(self, syms: list[int], text: str) -> bytes:
        """Merged symbols as ids; characters without a piece become bytes."""
        out, at = [], 0
        for s in syms:
            if s < self.n:
                out.append(s)
                at += self.lengths[s]
            else:
                out.extend(self.byte_ids[b] for b in text[at].encode())
                at += 1
        return np.array(out, np.int32).tobytes()

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of every word as 32-bit numbers. Very long words are first cut where no piece of
        the vocabulary has the two characters next to each other."""
        parts, owner = [], []
        for i, word in enumerate(words):
            cuts = [0]
            if len(word) > LONG_WORD:
                cuts += [k for k in range(1, len(word)) if word[k - 1:k + 1] not in self.neighbours]
            for a, b in zip(cuts, [*cuts[1:], len(word)]):
                parts.append(word[a:b])
                owner.append(i)
        out = [b""] * len(words)
        short = [p for p, part in enumerate(parts) if len(part) <= LONG_WORD]
        done = {}
        if short:
            word = np.repeat(np.arange(len(short)), [len(parts[p]) for p in short])
            syms, word = self.merge_words(self._spell("".join([parts[p] for p in short])), word)
            bounds = np.searchsorted(word, np.arange(len(short) + 1)).tolist()
            flat = syms.astype(np.int32).tobytes()
            # Words with an unknown character go through the byte fallback.
            odd = set(word[syms >= self.n].tolist())
            for k, p in enumerate(short):
                a, b = bounds[k], bounds[k + 1]
                done[p] = self._ids(syms[a:b].tolist(), parts[p]) if k in odd else flat[4 * a:4 * b]
        for p, part in enumerate(parts):
            ids = done[p] if p in done else self._ids(self.merge_long(self._spell(part)).tolist(), part)
            out[owner[p]] += ids
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts, the end id last. An empty text is the end id alone."""
        words = [self.word.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        wanted = set()
        for w in words:
            wanted.update(w)
        if len(self.known) + len(wanted) > KNOWN_WORDS:
            self.known.clear()
        new = [w for w in wanted if w not in self.known]
        table = dict(zip(new, self.encode_words(new)))
        self.known.update((w, b) for w, b in table.items() if len(w) <= LONG_WORD)
        # Words too long to keep stay in this call's table only.
        look = self.known if all(len(w) <= LONG_WORD for w in new) else {**{w: self.known[w] for w in wanted if w in self.known}, **table}
        end = np.array([self.end], np.int32).tobytes()
        return [np.frombuffer(b"".join([*map(look.__getitem__, ws), end]), np.int32) for ws in words]

    # -- decoding ---------------------------------------------------------

    def decode(self, ids) -> str:
        """The text of ids: control ids vanish, byte ids join to characters, and
        the space put before the first word goes. Bytes that form no character
        become U+FFFD each."""
        ids = list(ids)
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        first = next((i for i in ids if self.bytes_of[i]), None)
        if first is not None and self.starts_with_space[first]:
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            out, at = [], 0
            while at < len(raw):
                try:
                    out.append(raw[at:].decode())
                    break
                except UnicodeDecodeError as e:
                    out.append(raw[at:at + e.start].decode() + "�")
                    at += e.start + 1
            return "".join(out)


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def tokenizer_path(name: str) -> str:
    """A public vocabulary's place on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_codec(docs: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text",
                with_ids: bool = False) -> DataFrame:
    """Encode and decode every text: ``id_col``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``
    and, with ``with_ids``, ``ids`` and ``decoded``.

    A NULL text counts as empty and gives the end id alone. Other columns are
    not read. No shuffle; memory follows the longest text. ``model`` is a file
    name of the public vocabularies or a path.
    """
    extra = ", ids array<int>, decoded string" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = piece_model(model if "/" in model else tokenizer_path(model))
        for batch in chunks(batches, "_text"):
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            n, sha, back, all_ids, all_text = [], [], [], [], []
            for ids in m.encode(texts):
                listed = ids.tolist()
                text = m.decode(listed)
                n.append(len(listed))
                sha.append(hashlib.sha256(b" ".join(map(m.decimal.__getitem__, listed))).hexdigest())
                back.append(hashlib.sha256(text.encode()).hexdigest())
                if with_ids:
                    all_ids.append(listed)
                    all_text.append(text)
            columns = [batch.column("_id"), pa.array(n, pa.int64()), pa.array(sha), pa.array(back)]
            if with_ids:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(
        docs.selectExpr(f"`{id_col}` AS _id", f"`{text_col}` AS _text"), run,
        f"_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{extra}").withColumnRenamed("_id", id_col)
