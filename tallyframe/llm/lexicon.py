"""Byte-level BPE by a minimal acyclic transducer of frequent words.

The words of a text (the pre-tokens of the tokenizer's file) are counted over all documents. The most frequent ones,
at most LEXICON_WORDS, are compiled into an acyclic transducer: arcs read a byte and write ids, words with a common
start share arcs, whose output is the ids common to all words behind them, and states with equal rights, the same
arcs, targets and outputs, are one state, so words with a common end share arcs as well. The automaton is built word
by word in sorted order; what can no longer change is looked up among the states made so far. It is written as flat
arrays into the shared folder, sent as a file to every executor, a late one too, and mapped into memory, so a
machine's workers have one copy of it.

The distinct words of a batch of texts are looked up together, a byte of all of them at a time. A word that the
automaton does not hold is merged exactly: the pair of lowest rank first, the leftmost of equal ones. Which words are in
the automaton has no influence on the result. Ids are decoded by the bytes of each.

The pattern of words is that of the file's kind, with classes of characters as in the tokenizers library; where the
installed pattern module and the library disagree on a character, texts that hold it are divided by the library.

Defined results: a null text is an empty one and has no ids; bytes that are not UTF-8 once decoded become U+FFFD; every row comes
back once, equal ones and null doc_ids included; other columns are ignored; an empty table stays empty.
"""

from __future__ import annotations

import heapq
import json
import mmap
import os
import re
import uuid
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import common

#: Words in the automaton, and bytes of one; distinct parts of texts that a task counts before it hands them over; bytes
#: of texts encoded together; words looked up at once; a rank that no pair has.
LEXICON_WORDS, LONGEST, COUNTED, AT_ONCE, LOOKED_UP, NONE = 65_536, 32, 200_000, 8 << 20, 32_768, 1 << 30
#: White space of the library's patterns, and the pattern of byte-level files.
WHITE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


#: Bytes of UTF-8 that occur in characters below U+0540, which both modules know alike.
_BEFORE_UNSURE = bytes(range(0xD5))


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file: printable ones of Latin-1 for themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id, all that decoding needs."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    letters, ids, added = byte_letters(), file["model"]["vocab"], file.get("added_tokens") or []
    out = [b""] * (max([*ids.values(), *(t["id"] for t in added)]) + 1)
    for token, i in ids.items():
        out[i] = bytes(map(letters.__getitem__, token))
    for t in added:
        out[t["id"]] = t["content"].encode()
    return out


def text_of(ids: Iterable[int], of: list[bytes]) -> str:
    return b"".join(map(of.__getitem__, ids)).decode("utf-8", "replace")


class Vocabulary:
    """Ranks of pairs, ids of single bytes and strings of added tokens of a byte-level file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        before, model = file.get("pre_tokenizer") or {}, file["model"]
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex") or file.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError(f"{path} is not a plain byte-level file")
        added = file.get("added_tokens") or []
        if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path} has added tokens that take in what is next to them")
        letters, ids = byte_letters(), model["vocab"]
        self.byte_id = [0] * 256
        for letter, b in letters.items():
            self.byte_id[b] = ids[letter]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        self.added = {t["content"]: t["id"] for t in added}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.unsure = self._unsure()
        self.keys = np.array(sorted(a << 32 | b for a, b in self.pairs), np.int64)
        self.ranks, self.made = (np.array(x, np.int32) for x in zip(*(self.pairs[int(k) >> 32, int(k) & 0xFFFFFFFF] for k in self.keys)))
        self.first = np.array(self.byte_id, np.int32)

    def _unsure(self):
        """The letters and numbers that the library takes for something else."""
        known = regex.compile(r"[\p{L}\p{N}]")
        wrong = []
        for kind, other in (("L", "a"), ("N", "1")):
            chars = regex.findall(rf"\p{{{kind}}}", "".join(chr(c) for c in range(0x250, 0x110000) if not 0xD800 <= c < 0xE000))
            spans = [s for _, s in self.library.pre_tokenize_str("".join(f"{other}{c}\n" for c in chars))]
            whole = {start for start, end in spans if end - start == 2}
            wrong += [c for i, c in enumerate(chars) if 3 * i not in whole and known.match(c)]
        ranges: list[list[int]] = []
        for c in sorted(map(ord, wrong)):
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
        return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]") if wrong else None

    def words(self, text: str) -> list[str]:
        if self.unsure is not None and not text.isascii() and text.encode().translate(None, _BEFORE_UNSURE) and self.unsure.search(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        return WORDS.findall(text)

    def merged(self, word: bytes) -> list[int]:
        """Ids of a word: the pair of lowest rank is merged, the leftmost first, until none is left."""
        pairs = self.pairs
        ids = [self.byte_id[b] for b in word]
        n = len(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(*got, i, ids[i], ids[i + 1]) for i in range(n - 1) if (got := pairs.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, new, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two was merged since
            ids[i], ids[j] = new, -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if got := pairs.get((new, ids[k])):
                    heapq.heappush(heap, (*got, i, new, ids[k]))
            if (h := left[i]) >= 0 and (got := pairs.get((ids[h], new))):
                heapq.heappush(heap, (*got, h, ids[h], new))
        return [x for x in ids if x >= 0]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of each pair, NONE where it is no pair of the file."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        met = (self.keys[at] == key) & (right >= 0)
        return np.where(met, self.ranks[at], NONE), np.where(met, self.made[at], -1)

    def merged_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has and the ids of all in order: a merge of every word at a time, words of like lengths together."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts, data = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(words), np.uint8)
        counts, order, found, least = lengths.copy(), [], [], 0
        for most in (4, 8, 16, LONGEST):
            mine = np.flatnonzero((lengths > least) & (lengths <= most))
            least = most
            if not len(mine):
                continue
            column = np.arange(most)
            inside = column < lengths[mine][:, None]
            ids = np.where(inside, self.first[data[np.minimum(starts[mine][:, None] + column, len(data) - 1)]], -1)
            rank, new = np.full((len(mine), most), NONE), np.full((len(mine), most), -1)
            at = np.nonzero(inside[:, 1:])
            rank[at], new[at] = self._ranks(ids[:, :-1][at], ids[:, 1:][at])
            alive = np.arange(len(mine))
            while len(alive):
                best = rank[alive].argmin(1)
                going = rank[alive, best] < NONE
                alive, best = alive[going], best[going]
                if not len(alive):
                    break
                i, r, w = ids[alive], rank[alive], new[alive]
                row = np.arange(len(alive))
                i[row, best] = w[row, best]
                for x, end in ((i, -1), (r, NONE), (w, -1)):  # what is right of the merged pair moves one to the left
                    x[:, :-1] = np.where(column[:-1] > best[:, None] if x is i else column[:-1] >= best[:, None], x[:, 1:], x[:, :-1])
                    x[:, -1] = end
                r[row, best], w[row, best] = self._ranks(i[row, best], i[row, np.minimum(best + 1, most - 1)])
                last = best == most - 1
                r[row[last], best[last]], w[row[last], best[last]] = NONE, -1
                later = np.flatnonzero(best > 0)
                r[later, best[later] - 1], w[later, best[later] - 1] = self._ranks(i[later, best[later] - 1], i[later, best[later]])
                ids[alive], rank[alive], new[alive] = i, r, w
            kept = ids >= 0
            counts[mine] = kept.sum(1)
            order.append(mine)
            found.append(ids[kept])
        for i in np.flatnonzero(lengths > LONGEST).tolist():
            found.append(np.array(self.merged(words[i]), np.int64))
            counts[i] = len(found[-1])
            order.append(np.array([i]))
        if not order:
            return counts, np.empty(0, np.int64)
        order = np.concatenate(order)
        ends = np.cumsum(counts[order])
        back = np.empty(len(words), np.int64)
        back[order] = np.arange(len(order))
        return counts, taken(ends, np.concatenate(found), back)[1]


def taken(ends: np.ndarray, ids: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and ids, in order, of the runs numbered by which; a run ends where ends says and begins where the one before ends."""
    begin = np.where(which > 0, ends[which - 1], 0)
    sizes = ends[which] - begin
    return sizes, ids[np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]


def chunks(text: str) -> tuple[str, list[str]]:
    """What stands before the first space, and what follows each space. A space between characters that are not white begins a
    word in every case, so such parts are divided into words each by itself."""
    head, *rest = text.split(" ")
    return head, rest


def ragged(chunk: str) -> bool:
    """White space meets the space before or after this part: its text is divided as a whole."""
    return not chunk or chunk[0].isspace() or chunk[-1].isspace()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    found = Vocabulary(path)
    common.release()  # the parsed file
    return found


class _State:
    __slots__ = ("arcs", "final", "last")

    def __init__(self):
        self.arcs: list[list] = []  # byte, target, output
        self.final, self.last = False, ()


def _common(a: tuple, b: tuple) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class Builder:
    """The minimal transducer of words added in ascending order of their bytes, each with a tuple of ids."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.path, self.word = [_State()], b""

    def _freeze(self, state: _State) -> int:
        key = (state.final, state.last, tuple(map(tuple, state.arcs)))
        if (at := self.known.get(key)) is None:
            at = self.known[key] = len(self.states)
            self.states.append(key)
        return at

    def _shorten(self, length: int) -> None:
        while len(self.path) > length + 1:
            state = self.path.pop()
            self.path[-1].arcs[-1][1] = self._freeze(state)

    def add(self, word: bytes, ids: tuple[int, ...]) -> None:
        if self.states and word <= self.word or not word:
            raise ValueError("words come once each, in ascending order, none empty")
        shared = _common(word, self.word)
        self._shorten(shared)
        for depth in range(1, shared + 1):  # what not all words behind an arc begin with moves on
            state, arc = self.path[depth], self.path[depth - 1].arcs[-1]
            n = _common(arc[2], ids)
            if rest := arc[2][n:]:
                for a in state.arcs:
                    a[2] = rest + a[2]
                if state.final:
                    state.last = rest + state.last
                arc[2] = arc[2][:n]
            ids = ids[n:]
        for b in word[shared:]:
            self.path[-1].arcs.append([b, None, ()])
            self.path.append(_State())
        self.path[-1].final = True
        self.path[shared].arcs[-1][2] = ids
        self.word = word

    def finish(self) -> bytes:
        """Flat arrays: sorted keys state * 256 + byte with targets and outputs, last outputs of states (-1: not final), outputs."""
        self._shorten(0)
        root = self._freeze(self.path[0])
        pool: dict[tuple, int] = {(): 0}
        arcs = [(s << 8 | b, t, pool.setdefault(out, len(pool))) for s, (_, _, of) in enumerate(self.states) for b, t, out in of]
        last = [pool.setdefault(out, len(pool)) if final else -1 for final, out, _ in self.states]
        keys, targets, outs = (np.array(x, t) for x, t in zip(zip(*arcs) if arcs else ((), (), ()), ("<u8", "<i4", "<i4")))
        ends = np.cumsum([len(p) for p in pool], dtype="<i8")
        ids = np.array([i for p in pool for i in p], "<i4")
        arrays = [keys, ends, targets, outs, np.array(last, "<i4"), ids]
        head = np.array([root, *map(len, arrays)], "<i8")
        return head.tobytes() + b"".join(a.tobytes() for a in arrays)


def compiled(words: Iterable[bytes], vocabulary: Vocabulary) -> bytes:
    builder = Builder()
    for word in sorted(set(words)):
        builder.add(word, tuple(vocabulary.merged(word)))
    return builder.finish()


class Lexicon:
    """The transducer over a mapped file or bytes."""

    def __init__(self, data):
        head = np.frombuffer(data, "<i8", 7)
        self.root, at, arrays = int(head[0]), 56, []
        for n, t in zip(head[1:].tolist(), ("<u8", "<i8", "<i4", "<i4", "<i4", "<i4")):
            arrays.append(np.frombuffer(data, t, n, at))
            at += arrays[-1].nbytes
        self.keys, self.ends, self.targets, self.outs, self.last, self.ids = arrays

    def find(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words it holds, how many ids each has, and the ids of those, one after another."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        starts, data = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(words), np.uint8)
        alive = np.flatnonzero((lengths <= LONGEST) & (lengths > 0)) if len(self.keys) else np.empty(0, np.int64)
        state = np.full(n, self.root, np.int64)
        longest = int(lengths[alive].max(initial=0))
        written = np.zeros((n, longest + 1), np.int32)
        held = np.zeros(n, bool)
        for depth in range(longest + 1):
            done = lengths[alive] == depth
            ended = alive[done]
            last = self.last[state[ended]]
            written[ended, depth] = np.maximum(last, 0)
            held[ended] = last >= 0
            alive = alive[~done]
            if not len(alive):
                break
            key = state[alive].astype(np.uint64) << np.uint64(8) | data[starts[alive] + depth]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            met = self.keys[at] == key
            alive, at = alive[met], at[met]
            state[alive] = self.targets[at]
            written[alive, depth] = self.outs[at]
        sizes, ids = taken(self.ends, self.ids, written[held].ravel().astype(np.int64))
        counts = np.zeros(n, np.int64)
        counts[held] = sizes.reshape(-1, longest + 1).sum(1)
        return held, counts, ids


@lru_cache(maxsize=2)
def mapped(name: str) -> Lexicon:
    with open(SparkFiles.get(name), "rb") as f:
        return Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


class Encoder:
    def __init__(self, words: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon, self.looked_up, self.merges = words, lexicon, 0, 0

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ends of each word's ids, and the ids of all in order."""
        sizes, all_ids = [], []
        for at in range(0, len(words), LOOKED_UP):
            raw = [w.encode() for w in words[at : at + LOOKED_UP]]
            held, counts, found = self.lexicon.find(raw)
            unseen = [raw[i] for i in np.flatnonzero(~held).tolist()]
            self.looked_up, self.merges = self.looked_up + len(raw), self.merges + len(unseen)
            counts[~held], own = self.vocabulary.merged_all(unseen)
            ids, of_held = np.empty(int(counts.sum()), np.int32), np.repeat(held, counts)
            ids[of_held], ids[~of_held] = found, own
            sizes.append(counts)
            all_ids.append(ids)
        return np.cumsum(np.concatenate(sizes or [[]]), dtype=np.int64), np.concatenate(all_ids or [np.empty(0, np.int32)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Distinct parts of all texts are divided into words once, and distinct words looked up once."""
        v, parts, number, bad = self.vocabulary, [], {}, set()  # what no space stands before is in a tuple
        for text in texts:
            run: list = []
            for piece in v.cut.split(text) if v.cut is not None and "<" in text and v.cut.search(text) else (text,):
                if piece in v.added:
                    run.append(v.added[piece])
                elif piece:
                    head, rest = chunks(piece)
                    for c in set(rest).difference(number):
                        number[c] = len(number)
                        if ragged(c):
                            bad.add(c)
                    if head and head[-1].isspace() and rest or not bad.isdisjoint(rest):
                        head, rest = piece, ()
                    first = [number.setdefault((head,), len(number))] if head else []
                    run.append(np.fromiter((*first, *map(number.__getitem__, rest)), np.int32, len(first) + len(rest)))
            parts.append(run)
        words: dict[str, int] = {}
        of_part = (v.words(c[0] if type(c) is tuple else "" if c in bad else " " + c) for c in number)
        index, part_ends = array("i"), []
        for found in of_part:
            index.extend([words.setdefault(w, len(words)) for w in found])
            part_ends.append(len(index))
        ends, ids = self.ids(list(words))
        index, part_ends = np.frombuffer(index, np.int32) if len(index) else np.empty(0, np.int32), np.array(part_ends, np.int64)
        sizes, ids = taken(ends, ids, index) if len(index) else (index, ids)
        before = np.concatenate([[0], np.cumsum(sizes)])
        ends = before[part_ends] if len(part_ends) else part_ends
        out = []
        for run in parts:
            got = [np.array([part], np.int32) if isinstance(part, int) else taken(ends, ids, part)[1] for part in run]
            out.append(got[0] if len(got) == 1 else np.concatenate(got) if got else np.empty(0, np.int32))
        return out


def count_words(v: Vocabulary, texts: Iterable[str], most: int) -> Iterator[Counter]:
    """Words of the texts with their numbers, handed over whenever so many distinct parts have been met and at the end."""
    heads, spaced = Counter(), Counter()

    def words() -> Counter:
        found = Counter()
        for counts, lead in ((heads, ""), (spaced, " ")):
            for part, n in counts.items():
                for w in v.words(lead + part):
                    found[w] += n
            counts.clear()
        return found

    for text in texts:
        for piece in v.cut.split(text) if v.cut is not None and "<" in text and v.cut.search(text) else (text,):
            if piece and piece not in v.added:
                head, rest = chunks(piece)
                if head and head[-1].isspace() and rest or any(map(ragged, set(rest))):
                    heads[piece] += 1
                else:
                    heads[head] += 1
                    spaced.update(rest)
        if len(heads) + len(spaced) > most:
            yield words()
    yield words()


def _counted(path: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in count_words(vocabulary(path), (t.as_py() for batch in batches for t in batch.column(0)), most):
            few = {w: n for w, n in found.items() if len(w.encode()) <= LONGEST}
            yield pa.RecordBatch.from_arrays([pa.array(list(few), pa.string()), pa.array(list(few.values()), pa.int64())], ["word", "n"])

    return run


def frequent_words(docs: DataFrame, tokenizer: str, most: int = LEXICON_WORDS) -> list[str]:
    """The words that occur most often in all texts, at most `most` and each more than once."""
    counted = common.lean(docs).where("text IS NOT NULL AND text <> ''").select("text").mapInArrow(_counted(tokenizer, COUNTED), "word string, n long")
    top = counted.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.col("n").desc(), "word").limit(most)
    return [r.word for r in top.select("word").collect()]


def write_lexicon(spark: SparkSession, words: Iterable[str], tokenizer: str) -> str:
    """Compiles the words, stores the automaton in the shared folder and has it sent to executors; its name there."""
    data = compiled((w.encode() for w in words), vocabulary(tokenizer))
    at = f"{common.scratch(spark, 'lexicon')}/lexicon-{uuid.uuid4().hex}.bin"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(at)
    return at.rsplit("/", 1)[1]


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches together, until they have so many bytes."""
    some, held = [], 0
    for batch in batches:
        some.append(batch)
        held += batch.nbytes
        if held >= most:
            yield some
            some, held = [], 0
    if some:
        yield some


def encode(docs: DataFrame, tokenizer: str, lexicon: str) -> DataFrame:
    """doc_id and ids of every row; lexicon: a name that write_lexicon gave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(tokenizer), mapped(lexicon))
        for some in gathered(batches, AT_ONCE):
            found = iter(encoder.encode([t for batch in some for t in batch.column(1).to_pylist()]))
            for batch in some:
                mine = [next(found) for _ in range(batch.num_rows)]
                ends = np.cumsum([0, *map(len, mine)], dtype=np.int32)
                ids = np.concatenate(mine) if mine else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], ["doc_id", "ids"])

    return common.lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids and text of rows of doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = token_bytes(tokenizer)
        for batch in batches:
            for part in common.slices([batch]):
                texts = [text_of(ids.values.to_numpy(zero_copy_only=False).tolist() if ids.values is not None else (), of) for ids in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def op11_lexicon_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    file = public_tokenizers.path("byte_bpe_50k.json")
    docs = common.table(spark, sf_dir, "documents")
    lexicon = write_lexicon(spark, frequent_words(docs, file), file)
    back = decode(encode(docs, file, lexicon), file)
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
