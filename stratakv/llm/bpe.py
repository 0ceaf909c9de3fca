"""Byte-level BPE: frequent words from a memory-mapped minimal acyclic transducer, all others merged exactly."""

from __future__ import annotations

import atexit
import heapq
import json
import os
import shutil
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, map_text, small_batches

#: Words of the lexicon, the most frequent of the corpus; it bounds the shipped file, not what can be encoded.
LEXICON_WORDS = 1 << 17
#: Longest word (bytes) that the lexicon takes.
LEXICON_BYTES = 64
#: Words whose ids a task remembers; beyond, it starts anew.
MEMO_WORDS = 700_000
#: Characters of a text that are cut into words at a time.
PIECE = 1 << 20
#: Words of up to MANY_BYTES bytes are merged together, so many at a time; above LONG_WORD bytes one is merged with a heap.
MANY, MANY_BYTES, LONG_WORD = 1 << 13, 40, 96

# The pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
WORDS = regex.compile(PATTERN)
#: Between a character that is not white space and one that is, a word always ends.
EDGE = regex.compile(r"\P{White_Space}\p{White_Space}")
FAR = 1 << 30


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if it is printable Latin-1, else the next one from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {b: chr(b) for b in own}
    for k, b in enumerate(b for b in range(256) if b not in chars):
        chars[b] = chr(256 + k)
    return [chars[b] for b in range(256)]


class Merger:
    """Exact merges of a byte-level BPE vocabulary, read from its JSON text."""

    def __init__(self, spec: bytes):
        j = json.loads(spec)
        vocab, alphabet = j["model"]["vocab"], byte_alphabet()
        back = {c: b for b, c in enumerate(alphabet)}
        self.bytes_id = [vocab[c] for c in alphabet]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for pair in j["model"]["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a], vocab[b]] = len(self.made)
            self.made.append(vocab[a + b])
        keys = np.array([a << 32 | b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.pairs, self.pair_rank = keys[order], np.fromiter(self.rank.values(), np.int64, len(keys))[order]
        self.byte_ids, self.made_ids = np.array(self.bytes_id, np.int64), np.array(self.made, np.int64)
        self.special = {t["content"]: t["id"] for t in j.get("added_tokens", [])}
        self.text = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for t, i in [*vocab.items(), *self.special.items()]:
            self.text[i] = bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()

    def ids(self, word: bytes) -> list[int]:
        """Ids of one word: while a pair has a rank, the pair of least rank, the leftmost of equals, becomes one."""
        ids = [self.bytes_id[b] for b in word]
        if len(ids) > LONG_WORD:
            return self._long(ids)
        rank, made = self.rank.get, self.made
        ranks = [rank(p, FAR) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == FAR:
                break
            i = ranks.index(best)
            new = ids[i] = made[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], new), FAR)
            if i < len(ranks):
                ranks[i] = rank((new, ids[i + 1]), FAR)
        return ids

    def ids_many(self, words: Sequence[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers; all words take their next merge in step."""
        out: list[bytes] = [b""] * len(words)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero(lens > MANY_BYTES).tolist():
            out[i] = np.array(self.ids(words[i]), "<u4").tobytes()
        order = np.argsort(lens, kind="stable")
        order = order[lens[order] <= MANY_BYTES]
        for at in range(0, len(order), MANY):
            row = order[at : at + MANY]
            self._in_step(row, [words[i] for i in row.tolist()], lens[row], out)
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        want = a.astype(np.int64) << 32 | b
        k = np.minimum(np.searchsorted(self.pairs, want), len(self.pairs) - 1)
        return np.where(self.pairs[k] == want, self.pair_rank[k], FAR)

    def _in_step(self, row: np.ndarray, words: list[bytes], lens: np.ndarray, out: list[bytes]) -> None:
        width = int(lens[-1]) + 1  # the last place of a row stays empty
        cols = np.arange(width)
        ids = np.full((len(words), width), -1, np.int64)
        ids[cols < lens[:, None]] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        ranks = np.full((len(words), width), FAR, np.int64)
        pair = cols < lens[:, None] - 1
        ranks[pair] = self._ranks(ids[pair], np.roll(ids, -1, axis=1)[pair])
        while len(row):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(row)), at]
            done = best == FAR
            if done.any():
                for i, x in zip(row[done].tolist(), ids[done].astype("<u4"), strict=True):
                    out[i] = x.tobytes()
                for i, n in zip(row[done].tolist(), (ids[done] >= 0).sum(axis=1).tolist(), strict=True):
                    out[i] = out[i][: 4 * n]
                row, ids, ranks, at, best = (x[~done] for x in (row, ids, ranks, at, best))
                if not len(row):
                    break
            new, each = self.made_ids[best], np.arange(len(row))
            after = np.minimum(cols + (cols > at[:, None]), width - 1)
            ids = np.take_along_axis(ids, after, axis=1)
            ids[each, at] = new
            after = np.minimum(cols + (cols >= at[:, None]), width - 1)
            ranks = np.take_along_axis(ranks, after, axis=1)
            left = at > 0
            ranks[each[left], at[left] - 1] = self._ranks(ids[each[left], at[left] - 1], new[left])
            following = ids[each, np.minimum(at + 1, width - 1)]
            ranks[each, at] = np.where(following >= 0, self._ranks(new, following), FAR)

    def _long(self, ids: list[int]) -> list[int]:
        n, rank = len(ids), self.rank.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = self.made[r], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and (y := after[x]) >= 0 and (r := rank((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]


class Transducer:
    """A minimal acyclic automaton over words whose edges add up to a word's number, and the ids of each number.

    States with equal futures are one. An edge's output is how many words sort before those beyond it, so the sum
    over a word's path is its place in sorted order. It is a few flat arrays in one file, which workers map.
    """

    FIELDS = (("key", "<u4"), ("to", "<u4"), ("out", "<u4"), ("final", "u1"), ("at", "<u4"), ("ids", "<u4"))

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def compile(cls, words: dict[bytes, Sequence[int]]) -> Transducer:
        register: dict[tuple, int] = {}
        states: list[tuple] = []  # (is final, ((label, state), ...)), children before parents

        def settle(open_state: list) -> int:
            known = (open_state[0], tuple(open_state[1]))
            if known not in register:
                register[known] = len(states)
                states.append(known)
            return register[known]

        path, last, ordered = [[False, []]], b"", sorted(words)
        for word in ordered:
            same = len(os.path.commonprefix([word, last]))
            while len(path) > same + 1:
                done = settle(path.pop())
                path[-1][1].append((last[len(path) - 1], done))
            path += [[False, []] for _ in word[same:]]
            path[-1][0] = True
            last = word
        while len(path) > 1:
            done = settle(path.pop())
            path[-1][1].append((last[len(path) - 1], done))
        root = settle(path.pop())
        size: list[int] = []
        key, to, out = [], [], []
        number = lambda s: root - s  # noqa: E731  the root, settled last, is number 0
        for s, (final, edges) in enumerate(states):
            n = int(final)
            for label, child in edges:
                key.append(number(s) << 8 | label)
                to.append(number(child))
                out.append(n)
                n += size[child]
            size.append(n)
        order = np.argsort(np.array(key, "<u4"), kind="stable")
        outputs = [words[w] for w in ordered]
        return cls({
            "key": np.array(key, "<u4")[order], "to": np.array(to, "<u4")[order], "out": np.array(out, "<u4")[order],
            "final": np.array([f for f, _ in reversed(states)], "u1"),
            "at": np.concatenate([[0], np.cumsum([len(x) for x in outputs])]).astype("<u4"),
            "ids": np.array([i for x in outputs for i in x], "<u4"),
        })

    def save(self, path: str) -> None:
        with open(path, "wb") as f:
            f.write(np.array([len(getattr(self, n)) for n, _ in self.FIELDS], "<u8").tobytes())
            for n, kind in self.FIELDS:
                data = getattr(self, n).astype(kind).tobytes()
                f.write(data + b"\0" * (-len(data) % 8))

    @classmethod
    def load(cls, path: str) -> Transducer:
        raw = np.memmap(path, mode="r", dtype="u1")
        counts, at, arrays = raw[: 8 * len(cls.FIELDS)].view("<u8"), 8 * len(cls.FIELDS), {}
        for (n, kind), count in zip(cls.FIELDS, counts.tolist(), strict=True):
            size = count * np.dtype(kind).itemsize
            arrays[n] = raw[at : at + size].view(kind)
            at += size + -size % 8
        return cls(arrays)

    def find(self, words: Sequence[bytes]) -> np.ndarray:
        """Number of each word, -1 for those that are not in it; all words walk in step."""
        n = len(words)
        found = np.full(n, -1, np.int64)
        if not n or not len(self.key):
            return found
        lens = np.fromiter(map(len, words), np.int64, n)
        flat, starts = np.frombuffer(b"".join(words), "u1"), np.concatenate([[0], np.cumsum(lens)[:-1]])
        live = np.flatnonzero(lens > 0)
        state, total = np.zeros(n, np.uint32), np.zeros(n, np.int64)
        step = 0
        while len(live):
            want = state[live] << np.uint32(8) | flat[starts[live] + step]
            edge = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            ok = self.key[edge] == want
            live, edge = live[ok], edge[ok]
            state[live] = self.to[edge]
            total[live] += self.out[edge]
            step += 1
            ended = lens[live] == step
            done = live[ended]
            done = done[self.final[state[done]] == 1]
            found[done] = total[done]
            live = live[~ended]
        return found


def pieces(text: str, special: Iterable[str]) -> Iterable[tuple[str, bool]]:
    """(piece, is special): special strings apart, the rest in pieces that end where a word ends."""
    parts = regex.split("(" + "|".join(map(regex.escape, special)) + ")", text) if special and any(s in text for s in special) else [text]
    for k, part in enumerate(parts):
        at = 0
        while k % 2 == 0 and len(part) - at > PIECE:
            m = EDGE.search(part, at + PIECE)
            if m is None:
                break
            yield part[at : m.start() + 1], False
            at = m.start() + 1
        if len(part) > at:
            yield part[at:] if at else part, k % 2 == 1


_loaded: dict[str, object] = {}


def _once(key: str, make):
    """A worker process makes a thing once, and holds the last few only."""
    if key not in _loaded:
        while len(_loaded) >= 4:
            _loaded.pop(next(iter(_loaded)))
        _loaded[key] = make()
    return _loaded[key]


class Encoder:
    def __init__(self, merger: Merger, lexicon: Transducer):
        self.merger, self.lexicon, self.memo = merger, lexicon, {}
        self.special = {s: np.array([i], "<u4").tobytes() for s, i in merger.special.items()}

    def learn(self, words: Iterable[str]) -> None:
        new = [w for w in words if w not in self.memo]
        if len(self.memo) + len(new) > MEMO_WORDS:
            self.memo.clear()
            new = list(words)
        if not new:
            return
        raw = [w.encode() for w in new]
        numbers, at, ids = self.lexicon.find(raw), self.lexicon.at, self.lexicon.ids
        unseen = np.flatnonzero(numbers < 0).tolist()
        for i, x in zip(unseen, self.merger.ids_many([raw[i] for i in unseen]), strict=True):
            self.memo[new[i]] = x
        seen = np.flatnonzero(numbers >= 0)
        for i, a, b in zip(seen.tolist(), at[numbers[seen]].tolist(), at[numbers[seen] + 1].tolist(), strict=True):
            self.memo[new[i]] = ids[a:b].tobytes()

    def encode_all(self, texts: Sequence[str]) -> list[bytes]:
        """`encode` of each text; the words of many texts are learned together, and of long ones apart."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and len(texts[at]) <= PIECE and (size := size + len(texts[at])) <= 4 * PIECE:
                group.append([(WORDS.findall(p), None) if not special else ((), p) for p, special in pieces(texts[at], self.special)])
                at += 1
            if not group:
                out.append(self.encode(texts[at]))
                at += 1
                continue
            self.learn(set().union(*(words for text in group for words, _ in text)))
            get = self.memo.__getitem__
            out += [b"".join([b"".join(map(get, words)) if s is None else self.special[s] for words, s in text]) for text in group]
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = []
        for piece, special in pieces(text, self.special):
            if special:
                out.append(self.special[piece])
                continue
            words, had = WORDS.findall(piece), len(out)
            try:
                out.extend(map(self.memo.__getitem__, words))
            except KeyError:
                del out[had:]
                self.learn(set(words))
                out.append(b"".join(map(self.memo.__getitem__, words)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        text = self.merger.text
        return b"".join(map(text.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def count_words(docs: DataFrame, special: Sequence[str], id_col: str, text_col: str) -> DataFrame:
    """How often each word occurs in all texts: (w, n), counted a task first. Words over LEXICON_BYTES are left out."""

    def run(batches):
        counts: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                for piece, is_special in pieces(t or "", special):
                    if not is_special:
                        counts.update(WORDS.findall(piece))
            if len(counts) > MEMO_WORDS:
                yield _counted(counts)
                counts = Counter()
        yield _counted(counts)

    small_batches(docs.sparkSession)
    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))


def _counted(counts: Counter) -> pa.RecordBatch:
    kept = [(w, n) for w, n in counts.items() if len(w) <= LEXICON_BYTES]
    return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["w", "n"])


def compile_lexicon(docs: DataFrame, merger: Merger, size: int, id_col: str, text_col: str) -> Transducer:
    """The most frequent words of the corpus, as many as fit in `size` by steps of an eighth of a power of two.

    A histogram over those steps tells which count is enough, so no more than `size` words come to the driver.
    """
    counts = Table(count_words(docs, list(merger.special), id_col, text_col), "words")
    step = F.floor(F.log2("n") * 8).cast("int")
    total, least = 0, None
    for r in counts.df.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # 8 rows a power of two
        total += r["count"]
        if total > size:
            break
        least = r["step"]
    top = [] if least is None else counts.df.where(step >= least).collect()
    counts.drop()
    words = [r["w"].encode() for r in top]
    ids = merger.ids_many(words)
    return Transducer.compile({w: np.frombuffer(x, "<u4").tolist() for w, x in zip(words, ids, strict=True)})


def _ship(docs: DataFrame, lexicon: Transducer) -> str:
    """Gives the file to all executors, present and future, by Spark's own file service, which reads it until the end."""
    folder, name = os.path.realpath(tempfile.mkdtemp()), f"lexicon-{uuid.uuid4().hex}.bin"
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    lexicon.save(os.path.join(folder, name))
    docs.sparkSession.sparkContext.addFile(os.path.join(folder, name))
    return name


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = LEXICON_WORDS, decoded: bool = False) -> DataFrame:
    """One row a document: id, n_tokens, ids (binary, little-endian unsigned 32-bit), and with `decoded` their text.

    `tokenizer` is the path of a byte-level BPE in the JSON form of the tokenizers library. Special strings in a text
    become their own id. A null or empty text has no tokens. Repeated rows are encoded each.
    """
    with open(tokenizer, "rb") as f:
        spec = f.read()
    lexicon = compile_lexicon(docs, Merger(spec), lexicon_words, id_col, text_col)
    name, sent = _ship(docs, lexicon), docs.sparkSession.sparkContext.broadcast(spec)

    def start():
        merger = _once(f"merger-{hash(sent.value)}", lambda: Merger(sent.value))
        encoder = _once(name, lambda: Encoder(merger, Transducer.load(SparkFiles.get(name))))

        def run(texts):
            ids = encoder.encode_all([t or "" for t in texts])
            out = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            return out + [pa.array([encoder.decode(x) for x in ids], pa.string())] if decoded else out

        return run

    return map_text(docs, [id_col], text_col, start, "n_tokens long, ids binary" + ", decoded string" * decoded)
