"""Encoding a corpus with a public byte-level BPE tokenizer.

Texts are cut before every space that stands before something else than whitespace.  The tokenizer's own words never
reach over such a place, so the pieces between are encoded each for itself; they are what the lexicon calls a word.  The
words of the whole corpus are counted; the most frequent ones are compiled, with their ids, into a minimal acyclic
transducer: one automaton whose words share prefixes and suffixes and whose transitions carry numbers that add up to the
word's place in a table of ids.  Its arrays are shipped once to each executor and memory-mapped there, so the workers
of an executor share the pages.  All different words of an Arrow batch walk the automaton side by side, a byte at a
step.  A word that it doesn't hold is split as the tokenizer splits and merged exactly, by rank.  The lexicon is a matter
of speed alone: ids are the same with any lexicon, also an empty one.

Scale: one pass counts words (combined in each batch, then one aggregation), one pass encodes without any
shuffle.  To the driver come at most ``words`` words of at most ``LONGEST`` characters.
"""

from __future__ import annotations

import base64
import heapq
import io
import os
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewright.runtime import require_columns, shared_folder

#: Where the public vocabularies lie.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: How this vocabulary splits text into words before merging (a fixed value of the tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words of the lexicon, and characters that such a word has at most; longer ones are always merged.
WORDS, LONGEST = 50_000, 40
#: Words outside the lexicon whose ids a task keeps at a time.
KEPT = 200_000
#: Where texts are cut: whatever the tokenizer holds for whitespace, this expression does too.
_CUT = re.compile(r" (?=\S)")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word: always join the neighbours of lowest rank, the leftmost first.  n log n in its length."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end = list(range(1, n + 1)) + [n + 1]  # where the part that starts here ends; 0 for a start that is gone
    before = list(range(-1, n))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and end[i] < n and (rank := ranks.get(word[i:end[end[i]]])) is not None:
            heapq.heappush(heap, (rank, i, end[end[i]]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or not end[middle] or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
        offer(before[i])
        offer(i)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:end[i]]])
        i = end[i]
    return out


def compile_lexicon(words: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """The minimal acyclic transducer of the words, as arrays; words are added in order, suffixes shared as they end."""
    register: dict[tuple, int] = {}
    edges: list[tuple] = []  # of each finished state: ((label, state), ...)
    finals: list[bool] = []
    path: list[list] = [[False, []]]  # of the word added last: [final, finished edges]
    labels = b""

    def finish(depth: int) -> None:
        while len(path) > depth + 1:
            final, out = path.pop()
            key = (final, tuple(out))
            if key not in register:
                register[key] = len(edges)
                edges.append(tuple(out))
                finals.append(final)
            path[-1][1].append((labels[len(path) - 1], register[key]))

    order = sorted(words)
    for w in order:
        shared = 0
        while shared < min(len(w), len(labels)) and w[shared] == labels[shared]:
            shared += 1
        finish(shared)
        labels = w
        path.extend([False, []] for _ in range(len(w) - shared))
        path[-1][0] = True
    finish(0)
    edges.append(tuple(path[0][1]))
    finals.append(path[0][0])
    held = [0] * len(edges)  # words from this state on; a state's targets have lower numbers
    first, label, target, number = [0], [], [], []
    for s, out in enumerate(edges):
        held[s] = int(finals[s])
        for a, t in out:
            label.append(a)
            target.append(t)
            number.append(held[s])
            held[s] += held[t]
        first.append(len(label))
    ids = [words[w] for w in order]
    state = np.repeat(np.arange(len(edges)), np.diff(first))
    return {
        "edge": state * 256 + np.array(label, np.int64), "target": np.array(target, np.int32), "number": np.array(number, np.int32),
        "final": np.array(finals, np.bool_), "start": np.cumsum([0, *map(len, ids)], dtype=np.int64), "ids": np.array([i for x in ids for i in x], np.int32),
    }


def look_up(lexicon: dict[str, np.ndarray], data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Places, in the lexicon's table of ids, of the words that lie in ``data`` from begin to end; -1 for words it doesn't hold."""
    edge, target, number = (np.asarray(lexicon[k]) for k in ("edge", "target", "number"))
    state, place = np.full(len(begin), len(lexicon["final"]) - 1), np.zeros(len(begin), np.int64)
    alive, at = np.arange(len(begin)), begin.astype(np.int64)
    while len(alive := alive[at[alive] < end[alive]]) and len(edge):
        wanted = state[alive] * 256 + data[at[alive]]
        found = np.minimum(np.searchsorted(edge, wanted), len(edge) - 1)
        known = edge[found] == wanted
        place[alive[~known]] = -1
        alive, found = alive[known], found[known]
        state[alive] = target[found]
        place[alive] += number[found]
        at[alive] += 1
    return np.where((at == end) & np.asarray(lexicon["final"])[state], place, -1)


def _pieces(texts: pa.StringArray) -> tuple[pa.ListArray, np.ndarray]:
    """The words of each text, without the space before them, and the texts' order in this list."""
    lists = pc.split_pattern(texts, " ")
    coded = lists.flatten().dictionary_encode()
    glued = np.array([not w or w[0].isspace() for w in coded.dictionary.to_pylist()], bool)[coded.indices.to_numpy()]
    starts = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])[:-1]
    glued[starts] = False
    uncut = np.logical_or.reduceat(glued, starts)  # a space before whitespace is no place to cut
    if not uncut.any():
        return lists, np.arange(len(texts))
    again = pa.array([_CUT.split(t) for t in texts.filter(pa.array(uncut)).to_pylist()], lists.type)
    return pa.concat_arrays([lists.filter(pa.array(~uncut)), again]), np.concatenate([np.flatnonzero(~uncut), np.flatnonzero(uncut)])


def encoder(vocabulary: str, lexicon_files: dict[str, str]) -> Callable[[pa.Array], tuple[pa.ListArray, np.ndarray]]:
    """A function from texts to their ids and the texts' order in this list, for use within one task."""
    import regex

    split = regex.compile(PATTERN).findall
    lexicon = {k: np.load(SparkFiles.get(f), mmap_mode="r") for k, f in lexicon_files.items()}
    ranks = read_ranks(SparkFiles.get(vocabulary))
    known: dict[str, list[int]] = {}

    def merged(piece: str) -> list[int]:
        out: list[int] = []
        for word in split(piece):
            ids = known.get(word)
            if ids is None:
                ids = merge(word.encode("utf-8", "replace"), ranks)
                if len(known) >= KEPT:
                    known.clear()
                if len(word) <= LONGEST:
                    known[word] = ids
            out += ids
        return out

    def encode(texts: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
        lists, order = _pieces(texts.cast(pa.string()).fill_null(""))
        offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
        coded = lists.flatten().dictionary_encode()
        codes, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        _, ends, data = words.buffers()
        ends = np.frombuffer(ends, np.int32, len(words) + 1, words.offset * 4)
        # a text's first word has no space before it: these are words of their own, behind the others
        heads, codes[offsets[:-1]] = np.unique(codes[offsets[:-1]], return_inverse=True)
        codes[offsets[:-1]] += len(words)
        inner = np.ones(len(codes), bool)
        inner[offsets[:-1]] = False
        place = look_up(lexicon, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), ends[:-1], ends[1:])
        asked = np.zeros(len(words), bool)
        asked[codes[inner]] = True
        begin, size = lexicon["start"][np.maximum(place, 0)], np.zeros(len(words) + len(heads), np.int64)
        size[:len(words)] = np.where(place >= 0, lexicon["start"][np.minimum(np.maximum(place, 0) + 1, len(lexicon["start"]) - 1)] - begin, 0)
        begin = np.concatenate([begin, np.zeros(len(heads), np.int64)])
        more: list[int] = []
        rare = np.flatnonzero(asked & (place < 0))
        for i, piece in zip([*rare, *range(len(words), len(begin))], [*(" " + w for w in words.take(pa.array(rare)).to_pylist()), *words.take(pa.array(heads)).to_pylist()]):
            ids = merged(piece)
            begin[i], size[i] = len(lexicon["ids"]) + len(more), len(ids)
            more += ids
        taken = size[codes]
        upto = np.concatenate([[0], np.cumsum(taken)])
        spots = np.repeat(begin[codes] - upto[:-1], taken) + np.arange(upto[-1])
        ids = np.concatenate([lexicon["ids"], np.array(more, np.int32)])[spots]
        return pa.ListArray.from_arrays(pa.array(upto[offsets].astype(np.int32)), pa.array(ids)), order

    return encode


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """How often each word of at most LONGEST characters occurs in all texts: (word, n).

    Words are what lies between single spaces; of a text's first one the missing space isn't told apart.
    """
    require_columns(df, text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pc.split_pattern(b.column(0).cast(pa.string()), " ").flatten().value_counts()
            word, n = found.field("values"), found.field("counts")
            short = pc.less_equal(pc.utf8_length(word), LONGEST)
            yield pa.RecordBatch.from_arrays([word.filter(short), n.filter(short)], ["word", "n"])

    return (df.select(F.col(text).alias("_text")).where("_text is not null").mapInArrow(count, "word string, n bigint")
            .groupBy("word").agg(F.sum("n").alias("n")))


def _share(spark: SparkSession, name: str, a: np.ndarray) -> None:
    """Write an array into the shared folder, from which executors fetch it once."""
    out = io.BytesIO()
    np.save(out, a)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/lexicon/{name}")
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    stream.write(bytearray(out.getvalue()))
    stream.close()
    spark.sparkContext.addFile(target.toString())


def ship_lexicon(df: DataFrame, text: str, words: int = WORDS, tokenizers: str = TOKENIZERS) -> tuple[str, dict[str, str]]:
    """Compile the most frequent words of all texts and ship the arrays and the vocabulary to the executors.

    Equally frequent words: the smaller one in byte order.  Gives names for ``encoder``.
    """
    spark: SparkSession = df.sparkSession
    path = os.path.join(tokenizers, VOCABULARY)
    ranks = read_ranks(path)
    import regex

    split = regex.compile(PATTERN).findall
    top = [r.word for r in word_counts(df, text).orderBy(F.desc("n"), "word").limit(words).collect()] if words else []
    arrays = compile_lexicon({w.encode("utf-8", "replace"): [i for x in split(" " + w) for i in merge(x.encode("utf-8", "replace"), ranks)]
                              for w in top if w and not w[0].isspace()})
    tag, names = uuid.uuid4().hex, {}
    for k, a in arrays.items():
        names[k] = f"{tag}-{k}.npy"
        _share(spark, names[k], a)
    spark.sparkContext.addFile(path)
    return VOCABULARY, names


def token_ids(df: DataFrame, row_id: str, text: str, words: int = WORDS, tokenizers: str = TOKENIZERS) -> DataFrame:
    """The ids of every text by the 50k byte-level BPE, without special tokens: (row_id, ids).

    One row for each row of the table, also for rows alike or with a null id.  An empty or null text has an
    empty list; strings of special tokens are ordinary text; texts of any length are encoded whole.  Other
    columns are ignored.
    """
    require_columns(df, row_id, text)
    shipped = ship_lexicon(df, text, words, tokenizers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for b in batches:
            encode = encode or encoder(*shipped)
            if b.num_rows:
                ids, order = encode(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(order)), ids], [row_id, "ids"])

    rows = df.select(row_id, F.col(text).alias("_text"))
    return rows.mapInArrow(run, f"`{row_id}` {dict(rows.dtypes)[row_id]}, ids array<int>")


def token_counts(df: DataFrame, keep: list[str], text: str, words: int = WORDS, tokenizers: str = TOKENIZERS) -> DataFrame:
    """The named columns and ``n_tokens``, the number of ids that ``token_ids`` gives for the row."""
    require_columns(df, *keep, text)
    shipped = ship_lexicon(df, text, words, tokenizers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for b in batches:
            encode = encode or encoder(*shipped)
            if b.num_rows:
                ids, order = encode(b.column(len(keep)))
                kept = [c.take(pa.array(order)) for c in b.columns[: len(keep)]]
                yield pa.RecordBatch.from_arrays([*kept, pc.list_value_length(ids).cast(pa.int64())], [*keep, "n_tokens"])

    rows = df.select(*keep, F.col(text).alias("_text"))
    types = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", n_tokens bigint")
