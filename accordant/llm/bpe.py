"""Byte-pair encoding by speculation and verification, and decoding.

A word is first cut greedily into the longest known tokens.  Such a cut is the
true encoding exactly when every token encodes to itself and no adjacent pair
hides an earlier merge, which is tested for all pairs of a batch at once with
numpy.  Only words with a failing pair go through the merges.  Words are found,
cut and merged side by side, a step of all of them at a time; each distinct word
of a stretch of texts is looked up once.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StringType, StructField, StructType
from tokenizers import Tokenizer

from accordant.llm.common import worker_cache

# What the vocabulary's own settings prescribe.
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
WORD_END = "</w>"
# Its pattern of words, with the classes written out for letters below U+0180.
LATIN, NUMBERS, SPACES = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN_WORD = f"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN}]+|[{NUMBERS}]|[^{SPACES}{LATIN}{NUMBERS}]+"

NEVER = np.int64(2**62)
#: Encodings a worker keeps at most, twice: those in use, and those before them.
WORDS_KEPT = 600_000
#: Letters beyond which a word's merges are done one by one.
LONG_WORD = 256
#: Bytes of text whose words are found at once; a longer text is taken alone.
BYTES_AT_ONCE = 2**22
TEXTS_AT_ONCE = 1024

# Kinds of bytes of text, and the byte after a word's last.
SPACE, LETTER, NUMBER, OTHER = range(4)
END = 256
# Letters up to here take at most two bytes, stay composed, and their lower case does, but for one.
PLAIN, NOT_PLAIN = 0x180, 0x130


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    # The bytes that stand for themselves, and where the others go.
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Memory(dict):
    """Encodings met so far.  When it is full, those not asked for since the last time go."""

    def __init__(self):
        super().__init__()
        self.older: dict[bytes, bytes] = {}

    def missing(self, wanted: set[bytes]) -> set[bytes]:
        """What is not known; what is known but old becomes new."""
        if len(self) > WORDS_KEPT:
            self.older = dict(self)
            self.clear()
        fresh = wanted.difference(self)
        again = fresh.intersection(self.older)
        self.update((w, self.older[w]) for w in again)
        return fresh - again


class Lookup:
    """Values of whole numbers, any array of which is looked up at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, absent: int):
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.last, self.absent = np.uint64(64 - bits), (1 << bits) - 1, absent
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        at = self.place(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            won = self.keys[at] == keys  # one of those that wanted the same place
            self.values[at[won]] = values[won]
            keys, values, at = keys[~won], values[~won], at[~won] + 1 & self.last

    def place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self.place(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], self.absent)
        on = np.flatnonzero((there != keys) & (there >= 0))
        while len(on):
            at[on] = at[on] + 1 & self.last
            there = self.keys[at[on]]
            same = there == keys[on]
            out[on[same]] = self.values[at[on[same]]]
            on = on[~same & (there >= 0)]
        return out


class WordBpe:
    """One vocabulary with its merge order, loaded from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.pieces = [""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for piece, i in vocab.items():
            self.pieces[i] = piece
        self.special = {}
        for token in spec["added_tokens"]:
            self.pieces[token["id"]] = token["content"]
            self.special[token["content"].encode()] = np.uint32(token["id"]).tobytes()
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        size = len(self.pieces)
        self.rank = np.full(size, -1, np.int64)  # when a token is made; -1: a letter
        self.rank[made] = np.arange(len(made))
        self.head, self.tail = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.head[made], self.tail[made] = left, right
        self.pairs = Lookup(left * size + right, np.arange(len(made)), NEVER)
        self.left, self.right, self.made = left, right, made

        # A token may be proposed only if its own letters merge to it.
        sound = np.ones(size, bool)
        fits = self.compatible(left, right, np.arange(len(made)))
        for a, b, m, ok in zip(left.tolist(), right.tolist(), made.tolist(), fits.tolist()):
            sound[m] = ok and sound[a] and sound[b]
        self.byte_of = {ord(x): b for b, x in enumerate(_byte_letters())}
        inner = {self.raw(p): i for p, i in vocab.items() if sound[i] and not p.endswith(WORD_END)}
        final = {self.raw(p[: -len(WORD_END)]): i for p, i in vocab.items() if sound[i] and p.endswith(WORD_END)}
        # Beginnings of tokens are numbered; a beginning and a byte lead to the next, 0 is none of it.
        node = {b"": 0}
        for p in chain(inner, final):
            for n in range(1, len(p) + 1):
                node.setdefault(p[:n], len(node))
        steps = [(node[p[:-1]] * (END + 1) + p[-1], i) for p, i in node.items() if p]
        steps += [(node[p] * (END + 1) + END, len(node) + n) for n, p in enumerate(final)]
        self.steps = Lookup(*np.array(steps, np.int64).T, -1)
        self.token_at = np.full(len(node) + len(final), -1, np.int64)  # -1: only the beginning of a token
        self.token_at[[node[p] for p in inner]] = list(inner.values())
        self.token_at[len(node) :] = list(final.values())
        self.letter, self.last_letter = np.zeros((2, 256), np.int64)
        for b, x in enumerate(_byte_letters()):
            self.letter[b], self.last_letter[b] = vocab[x], vocab[x + WORD_END]
        self.library = Tokenizer.from_file(path)
        self.plain_words = re.compile(LATIN_WORD).findall
        self.rare = re.compile("[\u0180-\U0010ffff]").search
        self.split_special = re.compile("(" + "|".join((re.escape(t.decode()) for t in self.special)) + ")").split
        self.words = Memory()
        self.kind, self.lower = np.full(PLAIN, OTHER, np.uint8), np.arange(PLAIN)
        for kind, members in ((SPACE, SPACES), (LETTER, LATIN), (NUMBER, NUMBERS)):
            self.kind[[i for i in range(PLAIN) if re.match(f"[{members}]", chr(i))]] = kind
        small = [i for i in range(PLAIN) if i != NOT_PLAIN]
        self.lower[small] = [ord(chr(i).lower()) for i in small]
        self.byte_kind, self.byte_lower = np.full(256, OTHER, np.uint8), np.arange(256).astype(np.uint8)
        self.byte_kind[:128], self.byte_lower[:128] = self.kind[:128], self.lower[:128]
        self.rank_of: Callable[[int], int | None] | None = None

    # -- verification ---------------------------------------------------------

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.pairs.get(left * len(self.pieces) + right)

    def compatible(self, left: np.ndarray, right: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge joins each pair across its border before ``limit``.

        Time is run backwards: the newer of the two tokens at the border is taken
        apart, and a merge of what then touches must not have been due while
        both sides existed.  At equal rank the left side merges first.
        """
        good = np.ones(len(left), bool)
        at = np.arange(len(left))
        x, y = left.astype(np.int64), right.astype(np.int64)
        due = np.full(len(left), NEVER) if limit is None else limit.astype(np.int64)
        while len(at):
            bad = self.pair_rank(x, y) < due
            good[at[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~bad & (np.maximum(rx, ry) >= 0)
            at, x, y, rx, ry = at[go], x[go], y[go], rx[go], ry[go]
            split_right = ry >= rx
            due = np.where(split_right, ry + 1, rx)
            x, y = np.where(split_right, x, self.tail[x]), np.where(split_right, self.head[y], y)
        return good

    # -- words ----------------------------------------------------------------

    def raw(self, word: str | bytes) -> bytes:
        """A word as bytes, from the vocabulary's letters."""
        return word if isinstance(word, bytes) else word.translate(self.byte_of).encode("latin-1")

    def flat(self, words: Sequence[str | bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of words in a row, and how many each has."""
        raw = list(map(self.raw, words))
        return np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, len(raw))

    def propose(self, word: str | bytes) -> list[int]:
        return self.proposals(*self.flat([word]))[0].tolist()

    def proposals(self, letters: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest known tokens from the left; a word's last one carries the word end.

        All words go on by a byte at a time.  Returns the tokens and whose they are.
        """
        end = np.cumsum(sizes + 1) - 1  # where a word's end stands
        byte = np.full(len(letters) + len(sizes), END, np.int64)
        byte[np.delete(np.arange(len(byte)), end)] = letters
        owner = np.arange(len(sizes))
        to = end - sizes  # the next byte to look at
        node, best, after = (np.zeros(len(sizes), np.int64) for _ in range(3))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(owner):
            following = self.steps.get(node * (END + 1) + byte[to])
            on = following >= 0
            token = np.where(on, self.token_at[following], -1)
            to = to + 1
            # The last letter belongs to a token with the word end.
            better = (token >= 0) & (to != end)
            best, after = np.where(better, token, best), np.where(better, to, after)
            cut = ~on | (to > end)
            if cut.any():
                done.append((owner[cut], best[cut]))
                to, node = np.where(cut, after, to), np.where(cut, 0, following)
                going = to <= end
                owner, end, to, node, best, after = (x[going] for x in (owner, end, to, node, best, after))
            else:
                node = following
        owner, token = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(owner, kind="stable")
        return token[order], owner[order]

    def merge_exactly(self, words: Sequence[str | bytes]) -> list[bytes]:
        """Apply the merges to each word in their order, leftmost first.

        Each round does the next due merge of every word still going.
        """
        letters, sizes = self.flat(words)
        token = self.letter[letters]
        last = np.cumsum(sizes) - 1
        token[last] = self.last_letter[letters[last]]
        owner = np.repeat(np.arange(len(words)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(token):
            rank = np.append(self.pair_rank(token[:-1], token[1:]), NEVER)
            rank[:-1][owner[1:] != owner[:-1]] = NEVER
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            size = np.diff(np.append(first, len(owner)))
            due = np.repeat(np.minimum.reduceat(rank, first), size)
            over = due == NEVER
            if over.any():
                done.append((owner[over], token[over]))
                token, owner, rank, due = token[~over], owner[~over], rank[~over], due[~over]
            hit = rank == due
            if not len(token):
                break
            # Of merges that touch, every second one happens, from the left.
            place = np.arange(len(hit))
            since = place - np.maximum.accumulate(np.where(hit, -1, place))
            at = np.flatnonzero(hit & (since % 2 == 1))
            token[at] = self.made[rank[at]]
            stays = np.ones(len(token), bool)
            stays[at + 1] = False
            token, owner = token[stays], owner[stays]
        owner, token = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(owner, kind="stable")
        ids = token[order].astype("<u4").tobytes()
        ends = 4 * np.cumsum(np.bincount(owner, minlength=len(words)))
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def merge_long(self, word: str | bytes) -> bytes:
        """The same for one long word: due merges wait in a heap, neighbours are linked."""
        raw = self.flat([word])[0]
        token = [*self.letter[raw[:-1]].tolist(), int(self.last_letter[raw[-1]])]
        after, before = list(range(1, len(token) + 1)), list(range(-1, len(token) - 1))
        ranks = self.pair_rank(np.array(token[:-1], np.int64), np.array(token[1:], np.int64))
        heap = [(r, i) for i, r in enumerate(ranks.tolist()) if r < NEVER]
        heapq.heapify(heap)
        if self.rank_of is None:
            self.rank_of = dict(zip((self.left * len(self.pieces) + self.right).tolist(), range(len(self.made)))).get
        rank_of, size, made = self.rank_of, len(self.pieces), self.made.tolist()
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if token[i] >= 0 else len(token)
            if j >= len(token) or rank_of(token[i] * size + token[j]) != rank:
                continue  # one side has merged since
            token[i], token[j], after[i] = made[rank], -1, after[j]
            if after[i] < len(token):
                before[after[i]] = i
                if (r := rank_of(token[i] * size + token[after[i]])) is not None:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := rank_of(token[before[i]] * size + token[i])) is not None:
                heapq.heappush(heap, (r, before[i]))
        return np.array([t for t in token if t >= 0], "<u4").tobytes()

    def encode_words(self, words: Sequence[str | bytes]) -> list[bytes]:
        """Encodings of distinct words, as little-endian 32-bit ids."""
        out = [b""] * len(words)
        for i in [i for i, w in enumerate(words) if len(w) > LONG_WORD]:
            out[i] = self.merge_long(words[i])
        rest = [i for i, w in enumerate(words) if len(w) <= LONG_WORD]
        if not rest:
            return out
        flat, owner = self.proposals(*self.flat([words[i] for i in rest]))
        inside = owner[1:] == owner[:-1]
        pairs, which = np.unique(flat[:-1][inside] * len(self.pieces) + flat[1:][inside], return_inverse=True)
        good = self.compatible(pairs // len(self.pieces), pairs % len(self.pieces))
        ids, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(np.bincount(owner, minlength=len(rest)))).tolist()
        for i, a, b in zip(rest, [0, *ends[:-1]], ends):
            out[i] = ids[a:b]
        failing = [rest[i] for i in np.unique(owner[1:][inside][~good[which]]).tolist()]
        if failing:
            for i, exact in zip(failing, self.merge_exactly([words[i] for i in failing])):
                out[i] = exact
        return out

    def found(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words of plain texts in their order, as bytes, and how many each text has.

        Plain texts have no special tokens and no letters of rarer scripts.
        """
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        byte = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        ends = offsets[1:] - offsets[0]
        # A space after each text, and some after all, so that no word goes on and all can look ahead.
        byte = np.insert(byte, np.append(ends, [ends[-1]] * 3), 32)
        ends = ends + np.arange(1, len(ends) + 1)
        kind, low = self.byte_kind[byte], self.byte_lower[byte]
        two = np.flatnonzero(byte >= 0xC0)
        letter = (byte[two].astype(np.int64) & 0x1F) << 6 | byte[two + 1] & 0x3F
        kind[two] = kind[two + 1] = self.kind[letter]
        low[two], low[two + 1] = 0xC0 | self.lower[letter] >> 6, 0x80 | self.lower[letter] & 0x3F
        # Numbers stand alone, other words go on as long as their kind does.
        starts = kind != np.append(np.uint8(SPACE), kind[:-1])
        starts |= (kind == NUMBER) & (byte & 0xC0 != 0x80)
        starts &= kind != SPACE
        # 's 't 're 've 'm 'll 'd are words, and what follows them is another.
        mark = np.flatnonzero(starts & (low == ord("'")))
        mark = mark[kind[mark + 1] == LETTER]
        one = mark[np.isin(low[mark + 1], list(b"stmd"))]
        both = mark[np.isin(low[mark + 1].astype(np.int64) << 8 | low[mark + 2], [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")])]
        starts[one + 1] = starts[both + 1] = False
        starts[one + 2] |= kind[one + 2] == LETTER
        starts[both + 3] |= kind[both + 3] == LETTER
        stays = kind != SPACE
        at = np.append(np.flatnonzero(starts[stays]), np.count_nonzero(stays)).astype(np.int64)
        counts = np.diff(np.searchsorted(np.flatnonzero(starts), np.append(0, ends)))
        words = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(low[stays].tobytes())])
        return words, counts

    def split(self, text: str) -> list[bytes]:
        """The words of any text, as bytes; special tokens stay whole.

        Letters of rarer scripts are classed by the library itself, since
        releases of Unicode differ.
        """
        out: list[bytes] = []
        for part in self.split_special(text):
            if part.encode() in self.special:
                out.append(part.encode())
            elif part and not self.rare(part):
                out += map(str.encode, self.plain_words(unicodedata.normalize("NFC", part).lower()))
            elif part:
                part = self.library.normalizer.normalize_str(part)
                out += [self.raw(w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(part)]
        return out

    # -- texts ----------------------------------------------------------------

    def plain(self, texts: pa.Array) -> np.ndarray:
        """Whether each text has neither special tokens nor letters of rarer scripts."""
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        byte = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        odd = np.flatnonzero(byte >= 0xC0 | PLAIN >> 6)
        for a, b in (b"<|", chr(NOT_PLAIN).encode()):
            odd = np.append(odd, np.flatnonzero((byte[:-1] == a) & (byte[1:] == b)))
        good = np.ones(len(texts), bool)
        good[np.searchsorted(offsets - offsets[0], odd, "right") - 1] = False
        return good

    def ids_of(self, words: pa.Array, counts: np.ndarray) -> list[bytes]:
        """Ids of texts, given their words and how many each has."""
        coded = words.dictionary_encode()
        offsets, byte = (memoryview(b or b"") for b in coded.dictionary.buffers()[1:])
        at, byte = offsets.cast("q").tolist(), byte.tobytes()
        every = [byte[a:b] for a, b in zip(at, at[1:])]
        fresh = self.words.missing(set(every))
        self.words.update((w, self.special[w]) for w in fresh & self.special.keys())
        new = list(fresh - self.special.keys())
        self.words.update(zip(new, self.encode_words(new)))
        parts = list(map(self.words.__getitem__, every))
        flat = np.frombuffer(b"".join(parts), "<u4")
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        which = coded.indices.to_numpy()
        many, ends = sizes[which], np.append(0, np.cumsum(sizes[which]))
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[which] - ends[:-1], many) + np.arange(ends[-1])].tobytes()
        cuts = (4 * ends[np.append(0, np.cumsum(counts))]).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode(self, texts: Sequence[str] | pa.Array) -> list[bytes]:
        """Ids of whole texts, each as little-endian 32-bit numbers; null is empty."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.large_string())
        texts = texts.cast(pa.large_string()).fill_null("")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy())
        out: list[bytes] = []
        while len(out) < len(texts):
            first = len(out)
            before = sizes[first - 1] if first else 0
            some = texts[first : max(first + 1, int(np.searchsorted(sizes, before + BYTES_AT_ONCE, "right")))]
            plain = self.plain(some)
            ids = iter(self.ids_of(*self.found(some.filter(pa.array(plain)))) if plain.any() else ())
            split = list(map(self.split, some.filter(pa.array(~plain)).to_pylist()))
            others = iter(self.ids_of(pa.array(chain.from_iterable(split), pa.large_binary()), list(map(len, split))) if split else ())
            out += [next(ids if p else others) for p in plain.tolist()]
        return out

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def vocabulary(path: str) -> WordBpe:
    """The vocabulary of this worker, with the words it has met so far."""
    return worker_cache(("bpe", path), lambda: WordBpe(path))


def _added(df: DataFrame, columns: dict[str, str]) -> StructType:
    """The columns of a table with some added; an added one replaces its namesake."""
    kept = [f for f in df.schema.fields if f.name not in columns]
    return StructType([*kept, *(StructField(n, {"binary": BinaryType(), "string": StringType()}[k]) for n, k in columns.items())])


def _mapped(df: DataFrame, source: str, columns: dict[str, str], make: Callable[[pa.Array], list[list]]) -> DataFrame:
    """Add columns made from one column, a few rows at a time."""
    schema = _added(df, columns)
    kept = [f.name for f in schema.fields[: -len(columns)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                made = make(part[source])
                arrays = [pa.array(m, getattr(pa, kind)()) for m, kind in zip(made, columns.values())]
                yield pa.RecordBatch.from_arrays([*(part[n] for n in kept), *arrays], names=[*kept, *columns])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, *, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """Add each text's ids as a binary column, four little-endian bytes per id.

    With ``decoded_col`` the text those ids decode to is added as well, in the
    same pass.  Null and empty texts give empty binaries; equal texts give equal
    ids; a text of any length is encoded whole; an empty table gives an empty
    one.  No special token is added, and those spelt out in a text become their
    own id.  All other columns stay; a column named as a new one is replaced.
    """
    columns = {ids_col: "binary"} | ({decoded_col: "string"} if decoded_col else {})

    def make(texts: pa.Array) -> list[list]:
        bpe = vocabulary(path)
        ids = bpe.encode(texts)
        return [ids, list(map(bpe.decode, ids))] if decoded_col else [ids]

    return _mapped(df, text_col, columns, make)


def decode(df: DataFrame, path: str, *, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """Add the tokens of each binary of ids, joined by spaces; null counts as empty."""

    def make(ids: pa.Array) -> list[list]:
        bpe = vocabulary(path)
        return [[bpe.decode(b or b"") for b in ids.to_pylist()]]

    return _mapped(df, ids_col, {decoded_col: "string"}, make)
