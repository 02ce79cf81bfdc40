"""Language ID by cross-parsing entropy over suffix automata."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LETTER = r"\p{L}"


#: Entries of all languages' tables together, four bytes each; transitions that have no room there are searched for.
ENTRIES = 1 << 26


def suffix_automaton(symbols: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``symbols``, by state. State 0 is the root."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols.tolist():
        now = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = now
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                clone = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = clone
                    p = link[p]
                link[q] = link[now] = clone
        last = now
    return go


class CrossParser:
    """Phrase counts of texts against one text of each language.

    A text is parsed from left to right into phrases, each the longest prefix
    of what is left that occurs in the language's text: the automaton is
    followed until it has no transition. Texts are lower-cased, characters
    other than letters become one blank. Every letter of the samples has its
    own symbol, and letters that no sample has match nothing. Transitions of
    the most frequent symbols are completed beforehand (a missing one ends the
    phrase and starts the next at the same character), so a step is one
    look-up for many texts at a time; those of other symbols, if there are
    more than ``dense``, are searched for in a sorted list. Long texts are
    parsed in pieces of ``piece`` characters side by side, and then as if they
    hadn't been cut: each piece is parsed on from where the one before it
    ended, until that parse and the piece's own are in the same state, from
    which on they agree.
    """

    def __init__(self, samples: dict[str, str], piece: int = 1024, dense: int = 64):
        self.langs, self.piece = sorted(samples), piece
        seen: Counter = Counter()
        for t in samples.values():
            seen.update(self.clean(t).replace(" ", ""))
        kept = sorted(seen, key=lambda c: (-seen[c], c))
        #: 0 is the blank, then letters by frequency; the last symbol stands for all characters that no sample has.
        self.n = len(kept) + 2
        self.lut = np.full(0x110000, self.n - 1, np.min_scalar_type(self.n))
        for i, c in enumerate(kept, 1):
            self.lut[ord(c)] = i
        self.lut[32] = 0
        #: Bits of a phrase: a place in the language's text.
        self.bits = np.array([entropy(1, 1, len(self.clean(samples[x]))) for x in self.langs])
        automata = [suffix_automaton(self.symbols(samples[x])) for x in self.langs]
        #: Columns of a table. Where there are fewer than symbols, the last one stands for those that are searched for.
        self.dense = min(self.n, max(1, min(dense, ENTRIES // max(sum(map(len, automata)), 1))))
        self.rare = self.dense - 1 if self.dense < self.n else self.n
        self.tables, self.sparse = [], []
        for go in automata:
            table, sparse = self.completed(go)
            self.tables.append(table)
            self.sparse.append(sparse)

    @staticmethod
    def clean(text: str) -> str:
        return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())

    def symbols(self, text: str) -> np.ndarray:
        return self.lut[np.frombuffer(self.clean(text).encode("utf-32-le"), np.uint32)]

    def completed(self, go: list[dict[int, int]]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The table, and for rare symbols sorted keys (state * symbols + symbol), their entries, and the entries that begin a phrase.

        Entries are 2 * (state * columns), and 1 more if a phrase begins there; state 0 has none in progress.
        """
        edges = np.array([(s, c, t) for s, out in enumerate(go) for c, t in out.items()], np.int64).reshape(-1, 3)
        begin = np.ones(self.n, np.int32)
        root = edges[edges[:, 0] == 0]
        begin[root[:, 1]] += (root[:, 2] * (2 * self.dense)).astype(np.int32)
        table = np.tile(begin[: self.dense], (len(go), 1))
        inner = edges[edges[:, 0] > 0]
        entry = (inner[:, 2] * (2 * self.dense)).astype(np.int32)
        few = inner[:, 1] >= self.rare
        table[inner[~few, 0], inner[~few, 1]] = entry[~few]
        keys = inner[few, 0] * self.n + inner[few, 1]
        order = np.argsort(keys)
        return table.ravel(), (keys[order], entry[few][order], begin)

    def searched(self, sparse: tuple[np.ndarray, np.ndarray, np.ndarray], state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Entries of rare symbols after ``state`` (as in the entries)."""
        keys, entry, begin = sparse
        if not len(keys):
            return begin[symbol]
        key = state.astype(np.int64) // (2 * self.dense) * self.n + symbol
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, entry[at], begin[symbol])

    def step(self, k: int, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Entries after ``state`` and ``symbol`` in the k-th language."""
        rare = np.flatnonzero(symbol >= self.rare)
        got = self.tables[k][(state >> 1) + np.minimum(symbol, self.dense - 1)]
        if len(rare):
            got[rare] = self.searched(self.sparse[k], state[rare], symbol[rare])
        return got

    def parse(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text in each language, and the symbols parsed. codes: all texts' symbols; starts: one more at the end."""
        sizes = np.diff(starts)
        pieces = -(-sizes // self.piece)
        owner = np.repeat(np.arange(len(sizes)), pieces)
        first = np.concatenate([[0], np.cumsum(pieces)])[:-1]
        nth = np.arange(len(owner)) - first[owner]
        begin = starts[:-1][owner] + nth * self.piece
        length = np.minimum(self.piece, sizes[owner] - nth * self.piece)
        order = np.argsort(-length, kind="stable")
        sorted_, longest = begin[order], -length[order]
        alive = np.searchsorted(longest, -np.arange(-longest[0] if len(longest) else 0), "left")
        states = [np.zeros(len(begin), np.int32) for _ in self.langs]
        counts = [np.zeros(len(begin), np.int32) for _ in self.langs]
        for i, n in enumerate(alive.tolist()):
            c = codes[sorted_[:n] + i].astype(np.int32)
            for k, (state, count) in enumerate(zip(states, counts, strict=True)):
                got = self.step(k, state[:n], c)
                count[:n] += got & 1
                state[:n] = got & -2
        out = np.zeros((len(sizes), len(self.langs)), np.int64)
        for k in range(len(self.langs)):
            end, count = np.empty_like(states[k]), np.empty(len(begin), np.int64)
            end[order], count[order] = states[k], counts[k]
            np.add.at(out[:, k], owner, count + self.carried(k, codes, begin, length, end, nth > 0))
        return out, sizes

    def carried(self, k: int, codes: np.ndarray, begin: np.ndarray, length: np.ndarray, end: np.ndarray, later: np.ndarray) -> np.ndarray:
        """How many phrases more each piece holds when it is parsed on from the end of the one before it.

        end: the state in which each piece's own parse ends; changed to that of the whole text's parse.
        """
        more = np.zeros(len(begin), np.int64)
        alone = end.copy()
        todo = np.flatnonzero(later)
        while len(todo):
            lane, own, on = todo, np.zeros(len(todo), np.int32), end[todo - 1]
            more[todo] = 0
            changed = []
            i = 0
            while len(lane):
                c = codes[begin[lane] + i].astype(np.int32)
                x, y = self.step(k, own, c), self.step(k, on, c)
                more[lane] += (y & 1) - (x & 1)
                own, on = x & -2, y & -2
                i += 1
                met, over = own == on, length[lane] == i
                done = met | over
                if done.any():
                    at = lane[done]
                    now = np.where(met[done], alone[at], on[done])
                    changed.append(at[end[at] != now])
                    end[at] = now
                lane, own, on = lane[~done], own[~done], on[~done]
            after = np.concatenate(changed) + 1
            after = after[after < len(begin)]
            todo = np.sort(after[later[after]])
        return more

    def predict(self, texts: list[str | None]) -> tuple[list[str | None], np.ndarray]:
        """The language with the least entropy (of equals the first by name), and how far the next is behind: 0 to 1."""
        joined = "\n".join((t or "").lower().replace("\n", " ") for t in texts) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.flatnonzero(codes == 10)
        letter = letters()
        blank = ~letter[np.minimum(codes, 0x10FFFF)]
        keep = ~blank
        keep[1:] |= blank[1:] & ~blank[:-1]
        keep[ends] = False
        symbols = self.lut[codes]
        symbols[blank] = 0
        kept = np.concatenate([[0], np.cumsum(keep)])
        starts = np.concatenate([[0], kept[ends + 1]])
        counts, _ = self.parse(symbols[keep], starts)
        if len(self.langs) == 0:
            return [None] * len(texts), np.zeros(len(texts))
        coded = counts * self.bits
        best = coded.argmin(1)
        if len(self.langs) == 1:
            return [self.langs[0]] * len(texts), np.ones(len(texts))
        least, second = np.partition(np.maximum(coded, 1), 1, 1)[:, :2].T
        return [self.langs[i] for i in best], np.clip(1 - least / second, 0.0, 1.0)


_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def sample_texts(docs: DataFrame, usable: Column, budget: int, rows: int) -> dict[str, str]:
    """Up to ``budget`` letters and blanks of every label, from at most ``rows`` documents a label.

    Documents are taken in the order of a hash of their text and doc_id.
    """
    rowed = docs.where(usable & F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(LETTER))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.length("text")), "doc_id")
    ids = rowed.select("lang", "doc_id", F.xxhash64("text").alias("__h"), F.row_number().over(order).alias("__r")).where(F.col("__r") <= rows)
    picked = rowed.withColumn("__h", F.xxhash64("text")).join(F.broadcast(ids), ["lang", "doc_id", "__h"])
    out: dict[str, list[str]] = {}
    size: Counter = Counter()
    for r in picked.select("lang", "__r", F.left("text", F.lit(budget)).alias("text")).orderBy("lang", "__r").toLocalIterator():
        t = CrossParser.clean(r["text"])[: budget - size[r["lang"]]]
        if t:
            out.setdefault(r["lang"], []).append(t)
            size[r["lang"]] += len(t)
    return {k: " ".join(v) for k, v in out.items()}


def train(docs: DataFrame, usable: Column | None = None, budget: int = 24_000, rows: int = 64) -> CrossParser:
    """Suffix automata of a sample of the labelled rows for which ``usable`` holds.

    The sample's bounds are parameters: ``budget`` characters of each label,
    from ``rows`` documents each. Every label is learned.
    """
    return CrossParser(sample_texts(docs, F.lit(True) if usable is None else usable, budget, rows))


def identify(docs: DataFrame, model: CrossParser, carry: list[str] | None = None) -> DataFrame:
    """doc_id, the ``carry`` columns, lang_pred and score for every row of ``docs``.

    Whole texts are parsed against each language; the language with the least
    entropy wins: phrases times the bits of a place in its sample (the text's
    length is the same for all and leaves their order as it is). score is 1
    less the ratio of the winner's entropy to the next one's. ``und`` with score 0: null text,
    text without a letter, or a model without languages. Repeated rows get
    equal answers; other columns are left out; an empty table gives no rows.
    """
    carry = [c for c in carry or [] if c not in ("doc_id", "lang_pred", "score")]
    fields = [docs.schema["doc_id"], *[docs.schema[c] for c in carry], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    text = "text" if "text" in carry else "__text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = shared.value
        for batch in batches:
            at = 0
            sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64) + 1
            ends = np.cumsum(sizes)
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 3_000_000, "right")))
                part = batch.slice(at, to - at)
                at = to
                usable = part.column("__usable").to_pylist()
                langs, score = parser.predict(part.column(text).to_pylist())
                langs = [x if u and x is not None else "und" for x, u in zip(langs, usable, strict=True)]
                score = np.where([x == "und" for x in langs], 0.0, score)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("doc_id", *carry)], pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["doc_id", *carry, "lang_pred", "score"])

    extra = [] if text in carry else [F.col("text").alias(text)]
    rows = docs.select("doc_id", *carry, *extra, F.coalesce(F.col("text").rlike(LETTER), F.lit(False)).alias("__usable"))
    return rows.mapInArrow(run, T.StructType(fields))


def entropy(phrases: int, length: int, sample: int) -> float:
    """Bits a character of a text of ``length`` parsed into ``phrases`` against ``sample`` characters."""
    return phrases * math.log2(max(sample, 2)) / max(length, 1)
