"""Byte-pair encoding by a minimal acyclic transducer.

The words that are most frequent in all documents are encoded once, and compiled into an automaton that
shares both prefixes and suffixes. Its arcs carry how many words they skip, so the sum along a word's path is
the word's number, and that leads to its ids. The tables are one file, which every Python worker maps into
memory; the words of a batch walk it together, an arc a step. Words that it lacks are merged exactly.
"""

from __future__ import annotations

import atexit
import json
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .sampling import most_frequent

#: Longest word in the automaton, in bytes; longer ones are merged.
LONGEST = 40
#: Fixed value: a word of this tokenizer family, in lower-case text of code points up to U+017F. Letters come first, as nothing else begins with one.
LATIN_WORD = r"[a-zªµºß-öø-ſ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9²³¹¼-¾]|[^a-zªµºß-öø-ſ0-9²³¹¼-¾\t-\r \x85\xa0]+"
#: Other code points, and the one whose lower case is two. Where a stretch between blanks has one, the library parts it.
BEYOND = r"[\u0130\u0180-\U0010ffff]"
#: Symbols from which on a word is merged by a queue.
LONG_WORD = 60


def _is_latin_1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Merger:
    """The vocabulary of a tokenizer file whose tokens end words with a mark, and the exact way of merging."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end, self.vocab = model["end_of_word_suffix"], model["vocab"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | self.special).items()}
        library = Tokenizer.from_file(path)
        self.normal, self.parted = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.latin_words, self.beyond, self.blank = re.compile(LATIN_WORD).findall, re.compile(BEYOND).search, re.compile("[ \n]").search
        self.parts = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else lambda t: [t]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.char_of = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def words(self, text: str) -> list[str]:
        """The words of a text in order; special tokens stand for themselves."""
        found: list[str] = []
        for part in self.parts(text):
            if part in self.special:
                found.append(part)
                continue
            if _is_latin_1(part):  # so are most, and that is quickly told
                found += self.latin_words(part.lower())
                continue
            at = 0
            while odd := self.beyond(part, at):
                first = max(part.rfind(" ", at, odd.start()), part.rfind("\n", at, odd.start()), at - 1) + 1
                last = blank.start() if (blank := self.blank(part, odd.end())) else len(part)
                found += self.latin_words(part[at:first].lower())
                normal = self.normal(part[first:last])
                found += [normal[a:b] for _, (a, b) in self.parted(normal)]
                at = last
            found += self.latin_words(part[at:].lower())
        return found

    def merged(self, word: str) -> list[int]:
        """Ids of one word: the pair of least rank is joined until none is known."""
        if word in self.special:
            return [self.special[word]]
        symbols = [self.char_of[b] for b in word.encode("utf-8", "surrogatepass")]
        symbols[-1] += self.end
        if len(symbols) >= LONG_WORD:
            return self._merged_by_queue(symbols)
        known, far = self.ranks.get, len(self.ranks)
        scores = [known(pair, far) for pair in zip(symbols, symbols[1:], strict=False)]
        while scores:
            least = min(scores)
            if least == far:
                break
            i = scores.index(least)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = known((symbols[i - 1], symbols[i]), far)
            if i < len(scores):
                scores[i] = known((symbols[i], symbols[i + 1]), far)
        return [self.vocab[s] for s in symbols if s in self.vocab]

    def _merged_by_queue(self, symbols: list[str]) -> list[int]:
        """The same for many symbols: pairs wait in a heap by rank and place, and joined symbols leave links to their neighbours."""
        n, known = len(symbols), self.ranks.get
        before, after = [*range(-1, n - 1)], [*range(1, n + 1)]
        heap = [(rank, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (rank := known((a, b))) is not None]
        heapify(heap)
        while heap:
            _, i, a, b = heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # one of the two has been joined since
            symbols[i], symbols[j] = a + b, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (rank := known((a + b, symbols[k]))) is not None:
                    heappush(heap, (rank, i, a + b, symbols[k]))
            if (h := before[i]) >= 0 and (rank := known((symbols[h], a + b))) is not None:
                heappush(heap, (rank, h, symbols[h], a + b))
        return [self.vocab[s] for s in symbols if s in self.vocab]

    def decoded(self, ids: list[int]) -> str:
        """The tokens of ids; this family has no decoder, so a blank stands between any two."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


def minimal_transducer(words: list[bytes]) -> dict[str, np.ndarray]:
    """The least acyclic automaton of distinct sorted words, by adding them one by one and sharing what is finished.

    Arrays: `key` (state * 256 + byte, ascending), `target` and `skip` of its arcs, `final` of its states.
    State 0 is the start. A word's number, in their order, is the sum of `skip` on its path.
    """
    arcs: list[dict[int, int]] = [{}]
    final, counts = [False], [0]
    known: dict[tuple, int] = {}
    path = [0]

    def finished(depth: int, word: bytes) -> None:
        """Replace the states of the last word beyond `depth` by equal ones that are known."""
        for at in range(len(path) - 1, depth, -1):
            state = path[at]
            form = (final[state], tuple(arcs[state].items()))
            same = known.setdefault(form, state)
            if same != state:
                arcs[path[at - 1]][word[at - 1]] = same
                spare.append(state)
        del path[depth + 1 :]

    spare: list[int] = []
    last = b""
    for word in words:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        finished(common, last)
        for byte in word[common:]:
            if spare:
                state = spare.pop()
                arcs[state], final[state] = {}, False
            else:
                state = len(arcs)
                arcs.append({})
                final.append(False)
            arcs[path[-1]][byte] = state
            path.append(state)
        final[path[-1]] = True
        last = word
    finished(0, last)
    # States in the order of a walk from the start; a state's count is how many words end below it.
    order, seen, stack = [], {0}, [0]
    while stack:
        state = stack.pop()
        order.append(state)
        for t in arcs[state].values():
            if t not in seen:
                seen.add(t)
                stack.append(t)
    counts = dict.fromkeys(order)
    stack = [0]
    while stack:
        state = stack[-1]
        todo = [t for t in arcs[state].values() if counts[t] is None]
        if todo:
            stack += todo
        else:
            counts[state] = final[state] + sum(counts[t] for t in arcs[state].values())
            stack.pop()
    number = {state: i for i, state in enumerate(order)}
    rows = []
    for state in order:
        skip = int(final[state])
        for byte in sorted(arcs[state]):
            target = arcs[state][byte]
            rows.append((number[state] * 256 + byte, number[target], skip))
            skip += counts[target]
    key, target, skip = (np.array(c, dtype=d) for c, d in zip(zip(*rows, strict=True), ("int64", "int32", "int32"), strict=True)) if rows else (np.zeros(0, d) for d in ("int64", "int32", "int32"))
    return {"key": key, "target": target, "skip": skip, "final": np.array([final[s] for s in order], dtype=bool)}


class Lexicon:
    """The automaton and the ids of its words, mapped from a file."""

    PARTS = (("key", "<i8"), ("target", "<i4"), ("skip", "<i4"), ("final", "?"), ("start", "<i8"), ("ids", "<i4"))

    def __init__(self, path: str):
        whole = np.memmap(path, mode="r", dtype="u1")
        sizes = whole[: 8 * len(self.PARTS)].view("<i8")
        at = 8 * len(self.PARTS)
        for (name, kind), n in zip(self.PARTS, sizes.tolist(), strict=True):
            width = np.dtype(kind).itemsize * n
            setattr(self, name, whole[at : at + width].view(kind))
            at += -(-width // 8) * 8

    @classmethod
    def save(cls, path: str, words: list[str], ids: list[list[int]]) -> None:
        """`words` distinct; ids in their order."""
        pairs = sorted(zip([w.encode() for w in words], ids, strict=True))
        parts = minimal_transducer([w for w, _ in pairs])
        parts["start"] = np.cumsum([0, *[len(i) for _, i in pairs]])
        parts["ids"] = np.array([x for _, i in pairs for x in i])
        with open(path, "wb") as f:
            f.write(np.array([len(parts[name]) for name, _ in cls.PARTS], dtype="<i8").tobytes())
            for name, kind in cls.PARTS:
                raw = parts[name].astype(kind).tobytes()
                f.write(raw + bytes(-len(raw) % 8))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, -1 for a word that isn't there. All words take a step at a time."""
        out = np.full(len(words), -1, dtype="int64")
        if not words or not len(self.key):
            return out
        lengths = np.fromiter(map(len, words), dtype="int64", count=len(words))
        live = np.flatnonzero((lengths <= LONGEST) & (lengths > 0))
        table = np.array([words[i] for i in live], dtype=f"S{LONGEST}").view("u1").reshape(len(live), LONGEST) if len(live) else np.zeros((0, LONGEST), "u1")
        rows, state, total = np.arange(len(live)), np.zeros(len(live), "int64"), np.zeros(len(live), "int64")
        for step in range(LONGEST + 1):
            ended = lengths[live[rows]] == step
            done = ended & self.final[state]
            out[live[rows[done]]] = total[done]
            rows, state, total = rows[~ended], state[~ended], total[~ended]
            if not len(rows) or step == LONGEST:
                break
            want = state * 256 + table[rows, step]
            arc = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            there = self.key[arc] == want
            rows, arc = rows[there], arc[there]
            state, total = self.target[arc].astype("int64"), total[there] + self.skip[arc]
        return out

    def ids_of(self, number: int) -> list[int]:
        return self.ids[self.start[number] : self.start[number + 1]].tolist()


@lru_cache(maxsize=2)
def lexicon(name: str) -> Lexicon:
    return Lexicon(SparkFiles.get(name))


def frequent_words(docs: DataFrame, tokenizer: str, most: int) -> list[str]:
    """The most frequent words of all documents, `most` or, because of ties, fewer. Every word of every text is counted."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = merger(tokenizer).words
        counts: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for w in words(text or ""):
                    counts[w] = counts.get(w, 0) + 1
                if len(counts) > 400_000:
                    yield out()
        yield out()

    counts = docs.select("text").mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    with Scratch(docs.sparkSession, "lexicon") as work:
        totals = work.written(counts.filter(F.octet_length("word") <= LONGEST), "words")
        return [r["word"] for r in most_frequent(totals, most).select("word").collect()]  # `most` rows or fewer


def compiled_lexicon(docs: DataFrame, tokenizer: str, most: int) -> str:
    """Compiles the frequent words of `docs` and hands the file to all executors; returns its name there."""
    m = merger(tokenizer)
    words = sorted(frequent_words(docs, tokenizer, most))
    name = f"lexicon-{uuid.uuid4().hex}.fst"
    folder = tempfile.mkdtemp()  # the driver serves the file from here to executors, lost and new ones too, until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, name)
    Lexicon.save(path, words, [m.merged(w) for w in words])
    docs.sparkSession.sparkContext.addFile(path)
    return name


#: Words that this Python worker has merged, by tokenizer; its next tasks need many of them again.
_UNSEEN: dict[str, dict[str, tuple[str, str, int]]] = {}


def encoded(docs: DataFrame, tokenizer: str, most: int = 60_000, whole: bool = True) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text; with `whole`, also ids and decoded.

    Null and empty texts have no tokens. Rows are encoded each for itself: repeated rows, ties and null doc_ids
    come out as they went in, an empty table gives no rows, and other columns are not read. A text of any length is
    encoded whole, in time almost in proportion to it, one without white space too.
    """
    name = compiled_lexicon(docs, tokenizer, most)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * whole
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), *([pa.list_(pa.int32()), pa.string()] if whole else [])]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, lex = merger(tokenizer), lexicon(name)
        numbered: dict[int, tuple[str, str, int]] = {}  # at most one entry for each word of the lexicon
        unseen = _UNSEEN.setdefault(tokenizer, {})

        def shown(ids: list[int]) -> tuple[str, str, int]:
            return " ".join(map(str, ids)), m.decoded(ids), len(ids)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                place: dict[str, int] = {}
                texts = [[place.setdefault(w, len(place)) for w in m.words(t or "")] for t in part.column(1).to_pylist()]
                words = list(place)
                forms = []
                for word, n in zip(words, lex.numbers([w.encode("utf-8", "surrogatepass") for w in words]).tolist(), strict=True):
                    if n >= 0:
                        if (form := numbered.get(n)) is None:
                            form = numbered[n] = shown(lex.ids_of(n))
                    elif (form := unseen.get(word)) is None:
                        if len(unseen) >= 300_000:
                            unseen.clear()
                        form = unseen[word] = shown(m.merged(word))
                    forms.append(form)
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), texts, strict=True):
                    mine = [forms[i] for i in text]
                    shown_ids, shown_tokens, counts = zip(*mine, strict=True) if mine else ((), (), ())
                    ids, decoded = " ".join(shown_ids), " ".join(shown_tokens)
                    row = (doc_id, sum(counts), sha256(ids.encode()).hexdigest(), sha256(decoded.encode()).hexdigest())
                    rows.append((*row, [int(x) for x in ids.split()], decoded) if whole else row)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
