"""Benchmark decontamination: a BM25 inverted index of the test items, searched by block-max WAND.

Every training document is cut into passages of overlapping words, and every passage is a query. An
item's impacts are divided by the score of the item itself, so one threshold holds for all: the share
of its own score that a passage reaches. Items are ordered by length and go to blocks; the postings of a
term are its items in that order with their impacts, one term after the other, and each run of a term's
postings in a block keeps the largest impact in it. All passages of a batch go through the index in
step, with a cursor on the runs of each of a passage's terms. The cursors are put in order, and the
pivot is the first block at which the terms' largest impacts add up to the threshold: no block before
can hold a result, so cursors behind move up to it. If the largest impacts within the pivot block reach
the threshold, the block's postings are scored in full; else it is skipped. A passage is done when the
terms that are left can't reach the threshold. All items at or above it are retrieved. A retrieved item
is a leak where the whole document holds enough of its question's and of its answer's word shingles.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, read_table

#: BM25 parameters.
K1, B = 1.2, 0.75
#: Items in a block.
BLOCK = 32
#: Share of an item's own score that retrieves it; share of its shingles that confirms it.
RETRIEVE, CONFIRM = 0.5, 0.8
#: Words of a shingle.
SHINGLE = 5
#: Items and characters of a benchmark in one call: what is sent to all executors is checked against both.
MOST_ITEMS, MOST_CHARS = 100_000, 100_000_000
#: Items whose shingles are kept by a worker.
KNOWN_ITEMS = 4096
_WORD = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def parts(words: list[str]) -> tuple[list[str], list[str]]:
    """An item's question and answer: the last fifth of its words, at least SHINGLE of them, is the answer's end of it."""
    cut = len(words) - max(SHINGLE, len(words) // 5)
    return (words[: cut + SHINGLE - 1], words[cut:]) if cut >= 1 else (words, words)


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[k : k + SHINGLE]) for k in range(len(words) - SHINGLE + 1)} or ({tuple(words)} if words else set())


class Statistics:
    """What the score of any item depends on: the number of items, their mean length, and the number of items that hold a term."""

    def __init__(self, items: list[list[str]]):
        items = [w for w in items if w]
        self.items = len(items)
        self.mean = sum(map(len, items)) / max(len(items), 1)
        self.frequency = Counter(t for w in items for t in set(w))

    def idf(self, term: str) -> float:
        f = self.frequency[term]
        return float(np.log(1 + (self.items - f + 0.5) / (f + 0.5)))


class Index:
    """An inverted index of items. Impacts are shares of the item's own score."""

    def __init__(self, items: list[tuple[int, str | None]], statistics: Statistics | None = None):
        """statistics: those of the whole benchmark where these items are a part of it."""
        cut = sorted(((i, tokens(t)) for i, t in items if i is not None), key=lambda x: (len(x[1]), x[0], x[1]))
        self.items = [(i, w) for i, w in cut if w]
        n = len(self.items)
        statistics = statistics or Statistics([w for _, w in self.items])
        self.term = {t: k + 1 for k, t in enumerate(sorted({t for _, w in self.items for t in w}))}
        idf = {t: statistics.idf(t) for t in self.term}
        terms, docs, impacts = [], [], []
        for k, (_, w) in enumerate(self.items):
            own = {t: idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(w) / statistics.mean)) for t, f in Counter(w).items()}
            whole = sum(own.values())
            terms += [self.term[t] for t in own]
            docs += [k] * len(own)
            impacts += [x / whole for x in own.values()]
        terms, docs = np.array(terms, np.int64), np.array(docs, np.int64)
        order = np.lexsort((docs, terms))
        terms, self.item, self.impact = terms[order], docs[order].astype(np.int32), np.array(impacts)[order]
        self.blocks = -(-n // BLOCK)
        # runs of a term's postings in a block: term * blocks + block, first posting, largest impact
        key = terms * self.blocks + self.item // BLOCK
        self.begin = np.flatnonzero(np.diff(key, prepend=-1))
        self.run = key[self.begin]
        self.run_top = np.maximum.reduceat(self.impact, self.begin) if n else np.zeros(0)
        self.begin = np.append(self.begin, len(key))
        # of each term: its first run and the one after its last, and the largest impact
        self.first_run = np.searchsorted(self.run, np.arange(len(self.term) + 2) * max(self.blocks, 1))
        self.top = np.zeros(len(self.term) + 1)
        np.maximum.at(self.top, terms, self.impact)
        self.width = max((len(w) for _, w in self.items), default=1)
        self.known: dict[int, tuple[set, set]] = {}

    @property
    def impacts(self) -> np.ndarray:
        """The postings as a table of terms by items, for small indexes."""
        table = np.zeros((len(self.term) + 1, len(self.items)))
        table[np.repeat(self.run // max(self.blocks, 1), np.diff(self.begin)), self.item] = self.impact
        return table

    def term_ids(self, words: list[str]) -> list[int]:
        return list(map(self.term.get, words, repeat(0)))

    def _passages(self, texts: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, term) of the distinct known terms of all passages, in order, and the text of each passage.

        Passages are two steps long and each begins a step after the last: any run of as many words as
        the longest item lies within one.
        """
        lengths = np.array([len(t) for t in texts], np.int64)
        ids = np.fromiter(chain.from_iterable(texts), np.int32, int(lengths.sum()))
        steps = -(-lengths // self.width)
        first_passage = np.cumsum(steps) - steps
        begin = np.cumsum(lengths) - lengths
        at = np.flatnonzero(ids)
        of = np.searchsorted(begin + lengths, at, side="right")
        local = (at - begin[of]) // self.width
        passage, term = first_passage[of] + local, ids[at].astype(np.int64)
        second = local > 0
        n_terms = len(self.term) + 1
        key = np.concatenate([passage * n_terms + term, (passage[second] - 1) * n_terms + term[second]])
        key = np.unique(key.astype(np.uint32) if int(steps.sum()) * n_terms < 2**32 else key)
        return (key // n_terms).astype(np.int64), (key % n_terms).astype(np.int64), np.repeat(np.arange(len(texts)), steps)

    def search(self, texts: list[list[int]], least: float) -> dict[int, set[int]]:
        """For texts given by their words' term ids: the items that some passage of the text retrieves at `least` or more of their own score."""
        found: dict[int, set[int]] = defaultdict(set)
        passage, term, text_of = self._passages(texts)
        least -= 1e-6
        run = self.first_run[term]
        while True:
            live = run < self.first_run[term + 1]
            passage, term, run = passage[live], term[live], run[live]
            top = self.top[term]
            if len(passage):  # passages whose terms can't reach the threshold any more are done
                enough = np.bincount(passage, top)[passage] >= least
                passage, term, run, top = passage[enough], term[enough], run[enough], top[enough]
            if not len(passage):
                return found
            block = self.run[run] - term * self.blocks
            order = np.argsort(passage * self.blocks + block, kind="stable")
            passage, term, run, block, top = passage[order], term[order], run[order], block[order], top[order]
            first = np.flatnonzero(np.diff(passage, prepend=-1))
            counts = np.diff(np.append(first, len(passage)))
            total = np.cumsum(top)
            under = total - np.repeat(total[first] - top[first], counts) < least - 1e-9
            # the pivot is the block of the first cursor in order at which the terms' largest impacts reach the threshold
            pivot = np.repeat(block[first + np.minimum(np.add.reduceat(under, first, dtype=np.int64), counts - 1)], counts)
            behind = np.flatnonzero(block < pivot)
            run[behind] = np.searchsorted(self.run, term[behind] * self.blocks + pivot[behind])
            inside = np.flatnonzero(block <= pivot)
            inside = inside[run[inside] < self.first_run[term[inside] + 1]]
            inside = inside[self.run[run[inside]] == term[inside] * self.blocks + pivot[inside]]
            of = np.repeat(np.arange(len(first)), counts)[inside]
            tried = np.bincount(of, self.run_top[run[inside]], len(first)) >= least
            self._score(run[inside][tried[of]], of[tried[of]], least, found, pivot[first], text_of[passage[first]])
            run[inside] += 1

    def _score(self, run: np.ndarray, of: np.ndarray, least: float, found: dict[int, set[int]], pivot: np.ndarray, text: np.ndarray) -> None:
        """Add up the postings of runs in the block that a passage tries; `of` numbers the passages."""
        if not len(run):
            return
        sizes = self.begin[run + 1] - self.begin[run]
        ends = np.cumsum(sizes)
        posting = np.arange(ends[-1]) + np.repeat(self.begin[run] - (ends - sizes), sizes)
        numbers, place = np.unique(of, return_inverse=True)
        score = np.bincount(np.repeat(place, sizes) * BLOCK + self.item[posting] % BLOCK, self.impact[posting], len(numbers) * BLOCK)
        for k in np.flatnonzero(score >= least).tolist():
            number = numbers[k // BLOCK]
            found[int(text[number])].add(int(pivot[number]) * BLOCK + k % BLOCK)

    def halves(self, item: int) -> tuple[set, set]:
        """The shingles of an item's question and of its answer."""
        got = self.known.get(item)
        if got is None:
            if len(self.known) >= KNOWN_ITEMS:
                self.known.clear()
            question, answer = parts(self.items[item][1])
            got = self.known[item] = shingles(question), shingles(answer)
        return got

    def verified(self, item: int, has: set[tuple[str, ...]], least: float) -> tuple[float, float, bool]:
        """Shares of the question's and the answer's shingles that a document has, and whether both are enough."""
        q, a = (len(s & has) / len(s) for s in self.halves(item))
        return q, a, q >= least and a >= least


class Matcher:
    """The index of a benchmark, built in a worker when first used."""

    def __init__(self, items: DataFrame, item_col: str, item_text_col: str, retrieve: float, confirm: float):
        rows = items.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).cast("string").alias("t")).where("i is not null")
        size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.char_length("t")), F.lit(0)).alias("chars")).first()
        if size.n > MOST_ITEMS or size.chars > MOST_CHARS:
            raise ValueError(f"a benchmark of more than {MOST_ITEMS} items or {MOST_CHARS} characters goes in several calls")
        self.sent = items.sparkSession.sparkContext.broadcast(sorted(((r.i, r.t) for r in rows.collect()), key=lambda x: (x[0], x[1] or "")))
        self.retrieve, self.confirm, self.index = retrieve, confirm, None

    def leaks(self, column: pa.Array) -> list[tuple[int, int, float, float]]:
        """(row, item_id, question share, answer share) of all verified leaks in a column of texts."""
        if self.index is None:
            self.index = Index(self.sent.value)
        index, out = self.index, []
        for start in range(0, len(column) if index.items else 0, 128):
            texts = [tokens(t) for t in column.slice(start, 128).to_pylist()]
            for k, items in sorted(index.search([index.term_ids(w) for w in texts], self.retrieve).items()):
                words = texts[k]
                has = shingles(words)
                for item in sorted(items):
                    # an item shorter than a shingle is looked for as a run of its own length
                    own = len(index.items[item][1])
                    q, a, ok = index.verified(item, has if own >= SHINGLE else {tuple(words[j : j + own]) for j in range(len(words) - own + 1)}, self.confirm)
                    if ok:
                        out.append((start + k, index.items[item][0], q, a))
        return out


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", retrieve: float = RETRIEVE, confirm: float = CONFIRM) -> DataFrame:
    """(doc_id, item_id, question_share, answer_share double) for every verified leak.

    Whole texts are searched, passage by passage. An item with fewer words than a shingle is one
    shingle; null or wordless items and documents match nothing. Repeated rows of docs give repeated
    rows; items that share an id are separate items. A null doc_id stays null in its rows; items with a
    null id are left out. The items go to all executors and have one index, whose size is in
    proportion to their distinct words; more than MOST_ITEMS items or MOST_CHARS characters are
    refused. An empty table of docs or of items gives no rows. Other columns are not read, whatever
    their names.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    matcher = Matcher(items, item_col, item_text_col, retrieve, confirm)

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = matcher.leaks(batch.column(1))
        at, item_ids, questions, answers = ([x[k] for x in found] for k in range(4))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(item_ids, pa.int64()), pa.array(questions, pa.float64()), pa.array(answers, pa.float64())], names=["doc_id", "item_id", "question_share", "answer_share"])

    return map_arrow(docs, of, f"doc_id {dict(docs.dtypes)['doc_id']}, item_id long, question_share double, answer_share double")


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", retrieve: float = RETRIEVE, confirm: float = CONFIRM) -> DataFrame:
    """The rows of docs, all columns, that have no verified leak; as leaks() finds them, without a shuffle.

    Null, empty and wordless texts stay. Repeated rows are judged alike; an empty table gives no rows.
    """
    matcher = Matcher(items, item_col, item_text_col, retrieve, confirm)
    at = docs.columns.index(text_col)

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        bad = {x[0] for x in matcher.leaks(batch.column(at))}
        return batch.filter(pa.array([k not in bad for k in range(batch.num_rows)], pa.bool_()))

    return map_arrow(docs, of, docs.schema)


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    """doc_id, item_id and shares of every leak of a benchmark item."""
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


#: The leaks in DuckDB, by their definition alone: all documents against all items that share a shingle.
OP9_SQL = """
with items as (
  select item_id, regexp_extract_all(lower(text), '[\\pL\\pN_]+') as w from benchmark
), cut as (
  select item_id, w, len(w) - greatest(5, len(w) // 5) as c from items where len(w) >= 5
), halves as (
  select item_id, 'q' as part, case when c >= 1 then w[1 : c + 4] else w end as w from cut
  union all
  select item_id, 'a', case when c >= 1 then w[c + 1 :] else w end from cut
), wanted as (
  select distinct item_id, part, w[k : k + 4] as s from halves, range(1, 200000) as r(k) where k <= len(w) - 4
), sizes as (
  select item_id, part, count(*) as n from wanted group by item_id, part
), held as (
  select distinct doc_id, w[k : k + 4] as s
  from (select doc_id, regexp_extract_all(lower(text), '[\\pL\\pN_]+') as w from documents) d, range(1, 200000) as r(k)
  where k <= len(w) - 4
), common as (
  select doc_id, item_id, part, count(*) as n from held join wanted using (s) group by doc_id, item_id, part
), shares as (
  select doc_id, item_id,
    max(case when part = 'q' then common.n / sizes.n end) as question_share,
    max(case when part = 'a' then common.n / sizes.n end) as answer_share
  from common join sizes using (item_id, part) group by doc_id, item_id
)
select doc_id, item_id, question_share, answer_share from shares where question_share >= 0.8 and answer_share >= 0.8
"""
