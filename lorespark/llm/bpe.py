"""BPE encoding and decoding by speculation and verification.

Greedy longest match proposes the tokens of a word. A word's BPE encoding is right exactly if each token is what BPE
makes of the token's own text, and no merge crosses the border of any two neighbours. The second test runs for all
neighbours of a batch at once: both tokens are taken apart along the border, from their last merge back to characters,
and each pair that meets there must not have a merge that comes before the merge that took either of them away. Only
words with a failing pair, or a token that BPE would not make, are merged step by step: short ones side by side, each of
more than LONG letters by a heap of its merges, so that time grows with its length and not with the square of it.

Defined cases: a null text is an empty text; an empty text has no ids and decodes to an empty string; a text of any
length is encoded whole; equal texts get equal ids; a null list of ids decodes to an empty string; an id outside the
vocabulary decodes to nothing, as in the tokenizers library. Further input columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lorespark.llm.common import id_and_text, release, slices, texts

NEVER = np.int64(1) << 40
#: Letters of a word beyond which it is merged alone.
LONG = 200
#: Chunks of text without white space whose ids a task remembers, in each of two generations.
REMEMBERED = 120_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next unused one from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in out:
            out[b], n = chr(n), n + 1
    return [out[b] for b in range(256)]


class WordBpe:
    """Encoder for a byte-level vocabulary with word ends, lower case and dropped white space."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        # words, and the line feeds between the chunks that are looked at together
        self.words = regex.compile(split["pattern"]["Regex"] + r"|\n").findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        letters = byte_letters()
        letters[10] = "\n"  # no byte of a word, but the end of one
        self.letters = np.array([ord(x) for x in letters], dtype="<u2")
        n = max([*self.vocab.values(), *self.special.values()]) + 1
        self.strings = [""] * n
        for s, i in [*self.vocab.items(), *self.special.items()]:
            self.strings[i] = s
        self.letter_ids = np.array([self.vocab.get(x, 0) for x in letters], dtype=np.int64)
        self.end_ids = np.array([self.vocab.get(x + self.end, 0) for x in letters], dtype=np.int64)
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        found = ahocorasick.Automaton()
        for s, i in self.vocab.items():
            found.add_word(s.removesuffix(self.end) + "\n" if s.endswith(self.end) else s, i)
        found.add_word("\n", -1)
        found.make_automaton()
        self.matches = found.iter_long
        self._trees(merges, n)
        self.chunks: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _trees(self, merges: list[tuple[str, str]], n: int) -> None:
        """For each token: the rank of the merge that makes it (-1: none), its two parts, and whether BPE makes it of its own text."""
        a = np.array([self.vocab[x] for x, _ in merges], dtype=np.int64)
        b = np.array([self.vocab[y] for _, y in merges], dtype=np.int64)
        self.made = made = np.array([self.vocab[x + y] for x, y in merges], dtype=np.int64)
        self.born = np.full(n, -1, dtype=np.int64)
        self.left, self.right = np.arange(n), np.arange(n)
        for r in range(len(merges) - 1, -1, -1):
            self.born[made[r]], self.left[made[r]], self.right[made[r]] = r, a[r], b[r]
        keys = a << 20 | b
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int64)
        self.ranks: dict[int, int] = {}  # for long words only, so it is made with the first one
        made_ids = np.flatnonzero(self.born >= 0)
        fits = np.ones(n, dtype=bool)
        fits[made_ids] = self.fit(self.left[made_ids], self.right[made_ids], self.born[made_ids])
        for t in made_ids[np.argsort(self.born[made_ids])]:
            fits[t] &= fits[self.left[t]] and fits[self.right[t]]
        self.proper = fits

    def fit(self, one: np.ndarray, two: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For each two neighbours, whether no merge crosses their border (before the merge of rank limit)."""
        good = np.ones(len(one), dtype=bool)
        at = np.arange(len(one))
        one, two = one.copy(), two.copy()
        until_one = np.full(len(one), NEVER) if limit is None else limit.copy()
        until_two = until_one.copy() if limit is None else until_one - 1
        while len(at):
            rank = self.rank(one, two)
            # of equal merges the left one comes first: it wins over the right token's own, not over the left token's
            bad = (rank < until_one) & (rank <= until_two) & (rank < NEVER)
            good[at[bad]] = False
            born_one, born_two = self.born[one], self.born[two]
            go = ~bad & ((born_one >= 0) | (born_two >= 0))
            at, one, two, until_one, until_two, born_one, born_two = (x[go] for x in (at, one, two, until_one, until_two, born_one, born_two))
            later = born_one > born_two
            until_one, until_two = np.where(later, born_one, until_one), np.where(later, until_two, born_two)
            one, two = np.where(later, self.right[one], one), np.where(later, two, self.left[two])
        return good

    def rank(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Rank of the merge of each two tokens; NEVER if there is none."""
        key = one << 20 | two
        k = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[k] == key, self.pair_ranks[k], NEVER)

    def merged_long(self, letters: np.ndarray) -> list[int]:
        """Ids of one long word: always its merge of lowest rank, of equal ones the left."""
        ranks, made = self.ranks, self.made
        if not ranks:
            ranks.update(zip(self.pair_keys.tolist(), self.pair_ranks.tolist(), strict=True))
        n, ids = len(letters), [*self.letter_ids[letters[:-1]].tolist(), int(self.end_ids[letters[-1]])]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        todo = [r << 32 | k for k in range(n - 1) if (r := ranks.get(ids[k] << 20 | ids[k + 1])) is not None]
        heapq.heapify(todo)
        while todo:
            merge = heapq.heappop(todo)
            rank, k = merge >> 32, merge & 0xFFFFFFFF
            other = after[k]
            if ids[k] < 0 or other >= n or ranks.get(ids[k] << 20 | ids[other]) != rank:
                continue  # one of the two has changed since
            ids[k], ids[other] = int(made[rank]), -1
            after[k] = beyond = after[other]
            if beyond < n:
                before[beyond] = k
                if (r := ranks.get(ids[k] << 20 | ids[beyond])) is not None:
                    heapq.heappush(todo, r << 32 | k)
            if (left := before[k]) >= 0 and (r := ranks.get(ids[left] << 20 | ids[k])) is not None:
                heapq.heappush(todo, r << 32 | left)
        return [x for x in ids if x >= 0]

    def merged(self, letters: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids by merging of words given as bytes, and each id's word."""
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        sizes = np.diff(np.append(starts, len(word)))
        long = np.flatnonzero(sizes > LONG)
        if not len(long):
            return self.merged_together(letters, word)
        short = np.repeat(sizes <= LONG, sizes)
        parts = [self.merged_together(letters[short], word[short])] if short.any() else []
        for k in long.tolist():
            ids = self.merged_long(letters[starts[k] : starts[k] + sizes[k]])
            parts.append((np.array(ids, dtype=np.int64), np.full(len(ids), word[starts[k]])))
        return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])

    def merged_together(self, letters: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids by merging of short words given as bytes, and each id's word. In each round every word makes its merge of lowest rank, of equal ones the left."""
        last = np.append(word[1:] != word[:-1], True)
        ids = np.where(last, self.end_ids[letters], self.letter_ids[letters])
        done = []
        rank = np.append(np.where(word[1:] == word[:-1], self.rank(ids[:-1], ids[1:]), NEVER), NEVER)
        while len(ids):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(ids))))
            over = least == NEVER
            if over.any():
                done.append((ids[over], word[over]))
                ids, word, rank, least = ids[~over], word[~over], rank[~over], least[~over]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == least)
            at = at[np.append(True, word[at[1:]] != word[at[:-1]])]
            ids[at] = self.made[rank[at]]
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            ids, word, rank = ids[keep], word[keep], rank[keep]
            at = at - np.arange(len(at))
            last = np.append(word[1:] != word[:-1], True)
            for k in (at, at[at > 0] - 1):
                rank[k] = np.where(last[k], NEVER, self.rank(ids[k], ids[np.minimum(k + 1, len(ids) - 1)]))
        if not done:
            return ids, word
        return np.concatenate([x for x, _ in done]), np.concatenate([x for _, x in done])

    def learn(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of each chunk, as bytes: proposals, one check for all neighbours, merging for the words that fail."""
        # each letter is lowered alone, so a final sigma stays a common one
        text = unicodedata.normalize("NFC", b"\n".join(chunks).decode("utf-8", "replace")).replace("Σ", "σ").lower()
        found = self.words(text)
        breaks = np.fromiter(map("\n".__eq__, found), dtype=bool, count=len(found))
        chunk = np.cumsum(breaks)[~breaks]
        # the words, each ended by a line feed: as bytes, and in the vocabulary's letters
        plain = np.frombuffer(("\n".join([w for w in found if w != "\n"]) + "\n" * bool(len(chunk))).encode(), dtype=np.uint8)
        borders = np.flatnonzero(plain == 10)
        tokens = np.fromiter(self.matches(self.letters[plain].tobytes().decode("utf-16-le")), dtype=[("end", np.int64), ("id", np.int64)])
        ids, word = tokens["id"], np.searchsorted(borders, tokens["end"])
        wrong = np.zeros(len(borders), dtype=bool)
        wrong[word[(ids < 0) | ~self.proper[ids]]] = True
        inner = np.flatnonzero((word[1:] == word[:-1]) & (ids[1:] >= 0))
        pairs, back = np.unique(ids[inner] << 20 | ids[inner + 1], return_inverse=True)
        wrong[word[inner[~self.fit(pairs >> 20, pairs & 0xFFFFF)[back]]]] = True
        if wrong.any():
            owner = np.searchsorted(borders, np.arange(len(plain)))
            again = wrong[owner] & (plain != 10)
            right, which = self.merged(plain[again], owner[again])
            keep = ~wrong[word]
            ids, word = np.concatenate([ids[keep], right]), np.concatenate([word[keep], which])
            order = np.argsort(word, kind="stable")
            ids, word = ids[order], word[order]
        cuts = (np.searchsorted(chunk[word], np.arange(len(chunks) + 1)) * 4).tolist()
        whole = ids.astype(np.int32).tobytes()
        return [whole[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def special_chunk(self, chunk: bytes) -> bytes:
        """Ids of a chunk that holds special tokens."""
        out = b""
        for part in self.specials.split(chunk.decode("utf-8", "replace")):
            if part in self.special:
                out += np.int32(self.special[part]).tobytes()
            elif part:
                out += self.learn([part.encode()])[0]
        return out

    def encode(self, batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin and the last one's end."""
        split = [t.split() for t in batch]
        flat = [c for cs in split for c in cs]
        # two generations of what is remembered: the older one goes when the younger is full
        if len(self.chunks) > REMEMBERED:
            self.older, self.chunks = self.chunks, {}
        chunks, older = self.chunks, self.older
        ids = [*map(chunks.get, flat)]
        if None in ids:
            new = set(flat).difference(chunks)
            for c in new.intersection(older):
                chunks[c] = older[c]
            new.difference_update(chunks)
            special = {c for c in new if b"<|" in c and self.specials.search(c.decode("utf-8", "replace"))}
            chunks.update((c, self.special_chunk(c)) for c in special)
            if plain := [*new.difference(special)]:
                chunks.update(zip(plain, self.learn(plain), strict=True))
            ids = [*map(chunks.__getitem__, flat)]
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))]) // 4
        per_text = np.concatenate([[0], np.cumsum([len(cs) for cs in split])]).astype(np.int64)
        return np.frombuffer(b"".join(ids), dtype=np.int32), ends[per_text]


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """One encoder a Python worker."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def bpe_encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of each row's whole text. vocabulary: path of the tokenizer file on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch in slices(batches):
            ids, ends = bpe.encode(texts(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])
        # the worker waits for tasks that may be of another kind
        bpe.chunks, bpe.older = {}, {}
        release()

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """The columns doc_id and ids, and decoded: the tokens' strings joined by a space, special ones included (the vocabulary has no decoder)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = pa.array(loaded(vocabulary).strings)
        for batch in batches:
            ids = batch.column("ids")
            ids = pc.if_else(ids.is_valid(), ids, pa.scalar([], ids.type)) if ids.null_count else ids
            flat = ids.flatten()
            ends = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(ids), dtype=np.int64))])
            inside = np.asarray(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(strings))).fill_null(False), dtype=bool)
            if not inside.all():
                ends = np.concatenate([[0], np.cumsum(inside)])[ends]
                flat = flat.filter(pa.array(inside))
            tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), strings.take(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pc.binary_join(tokens, " ")], ["doc_id", "ids", "decoded"])
        release()

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
