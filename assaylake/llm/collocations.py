"""Phrase collocations of each language, from count tries of shards that are merged by prefix range.

A shard's trie has the language on top and the words of a phrase below, four deep at most. It is held as
sorted level arrays (parent, word, count), so a range of prefixes is one slice of each level. Cut points,
which a sample of phrases gives, split all tries alike; the slices of a range are serialised, sorted,
and meet in the task of their range, where they are merged level by level. Only the paths to the cut
points themselves cross ranges, and their counts are looked up.

The merged trie is kept where it is frequent. A phrase is never more frequent than its parts, so nothing
that is needed is lost. The walk down the merged trie gives the counts of left parts; suffix links (from a
phrase to the phrase without its first word) give those of right parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, join_salted

DEPTH, MIN_COUNT, TOP = 4, 30, 2000
#: A candidate goes if a longer one that holds it occurs in so many per cent of its places.
COVER_PCT = 80
SCALE = 2_000_000
NO_LANG = "und"

#: Characters of text in one shard (a text is cut between pieces, so a longer piece is held whole).
SHARD_CHARS = 8_000_000
#: Characters of text for each cut point, and how many cut points there are at most.
CUT_CHARS, CUTS = 4_000_000, 1 << 16
#: The sample behind the cut points: texts and phrases at most, about, and characters of a word.
SAMPLE_ROWS, SAMPLE_PHRASES, CUT_WORD_CHARS = 20_000, 1 << 17, 64

_BREAKS = r"[.,;:!?\x0A-\x0D]"


def word_stream(texts: list[str]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(ids of words, the words in byte order, text number) of some texts in one row; id -1 stands between pieces."""
    raw = pa.array(texts, pa.string())
    marked = pc.replace_substring_regex(pc.ascii_lower(raw), _BREAKS, " \n ")
    split = pc.split_pattern_regex(marked, "[ \t]+")
    flat, at = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy()
    coded = flat.dictionary_encode()
    words, ids = coded.dictionary, coded.indices.to_numpy()
    order = pc.sort_indices(words.cast(pa.binary())).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    words = words.take(pa.array(order))
    ids = rank[ids]
    blank, mark = pc.index(words, "").as_py(), pc.index(words, "\n").as_py()
    if blank >= 0:
        there = ids != blank
        ids, at = ids[there], at[there]
    if mark >= 0:
        ids[ids == mark] = -1
    return ids, words, at


class Trie:
    """Level arrays of the phrases of one shard, each level sorted by (parent, word); level 0 has the languages."""

    def __init__(self, langs: list[str], texts: list[str]):
        ids, self.words, at = word_stream(texts)
        self.langs, lang_of = np.unique(np.array(langs, dtype=object), return_inverse=True)
        self.size = len(self.words) + 1
        ends = np.empty(len(ids), bool)
        if len(ids):
            ends[:-1] = at[1:] != at[:-1]
            ends[-1] = True
        node, start = lang_of[at], np.flatnonzero(ids >= 0)
        node = node[start]
        langs_here, node, counts = np.unique(node, return_inverse=True, return_counts=True)
        self.langs = self.langs[langs_here]
        self.parents, self.labels, self.counts = [np.zeros(len(counts), np.int64)], [np.arange(len(counts))], [counts]
        place = start
        for depth in range(1, DEPTH + 1):
            if depth > 1:
                # The next word follows in the same text, and is a word.
                on = ~ends[place]
                place, node = place[on] + 1, node[on]
                on = ids[place] >= 0
                place, node = place[on], node[on]
            keys, node, counts = np.unique(node * self.size + ids[place], return_inverse=True, return_counts=True)
            self.parents.append(keys // self.size)
            self.labels.append(keys % self.size)
            self.counts.append(counts)

    def slices(self, cuts: list[tuple[str, ...]]) -> list[np.ndarray]:
        """For each level, the number of nodes before each cut point (a path: language, words)."""
        n = len(cuts)
        lang_order = np.searchsorted(self.langs, np.array([c[0] for c in cuts], dtype=object)) if len(self.langs) else np.zeros(n, int)
        exact = np.array([i < len(self.langs) and self.langs[i] == c[0] for i, c in zip(lang_order, cuts, strict=True)], bool)
        length = np.array([len(c) for c in cuts])
        # A node equal to the cut point isn't before it, one that is a prefix of it is.
        before = lang_order + (exact & (length > 1))
        out, node = [before], lang_order
        vocabulary = self.words.cast(pa.binary()).to_numpy(zero_copy_only=False)
        for depth in range(1, DEPTH + 1):
            keys = self.parents[depth] * self.size + self.labels[depth]
            word = [c[depth].encode() if len(c) > depth else b"" for c in cuts]
            rank = np.searchsorted(vocabulary, np.array(word, dtype=object)) if len(vocabulary) else np.zeros(n, int)
            held = np.array([i < len(vocabulary) and vocabulary[i] == w for i, w in zip(rank, word, strict=True)], bool)
            deep = length > depth
            wanted = np.where(exact & deep, node * self.size + rank, out[-1] * self.size)
            # What ends above this level begins with the first child of the node it names.
            wanted = np.where(exact & ~deep, node * self.size, wanted)
            place = np.searchsorted(keys, wanted)
            found = exact & deep & held & (place < len(keys)) & (keys[np.minimum(place, len(keys) - 1)] == wanted if len(keys) else False)
            out.append(place + (found & (length > depth + 1)))
            node, exact = np.where(found, place, node), exact & (found | ~deep)
            exact &= deep
        return out

    def segments(self, cuts: list[tuple[str, ...]]) -> Iterator[tuple[int, bytes]]:
        """(range, serialised slice) of each range of prefixes that has nodes; range i begins at cut point i - 1."""
        at = self.slices(cuts) if cuts else [np.zeros(0, int)] * (DEPTH + 1)
        bounds = [np.concatenate(([0], a, [len(c)])) for a, c in zip(at, self.counts, strict=True)]
        for i in range(len(cuts) + 1):
            spans = [(int(b[i]), int(b[i + 1])) for b in bounds]
            if any(lo < hi for lo, hi in spans):
                yield i, self._segment(spans)

    def _segment(self, spans: list[tuple[int, int]]) -> bytes:
        labels = [self.labels[d][lo:hi] for d, (lo, hi) in enumerate(spans)]
        used, local = np.unique(np.concatenate(labels[1:]), return_inverse=True)
        local = np.split(local, np.cumsum([len(x) for x in labels[1:]])[:-1])
        columns = []
        for d, (lo, hi) in enumerate(spans):
            # Parents before the slice are the node on the path to its cut point: -1.
            parents = self.parents[d][lo:hi] - spans[d - 1][0] if d else np.zeros(hi - lo, np.int64)
            label = local[d - 1] if d else np.arange(hi - lo)
            columns.append(pa.StructArray.from_arrays([pa.array(np.diff(parents, prepend=-1), pa.int32()), pa.array(label, pa.int32()), pa.array(self.counts[d][lo:hi], pa.int64())], ["step", "label", "count"]))
        lists = {f"level{d}": pa.ListArray.from_arrays([0, len(c)], c) for d, c in enumerate(columns)}
        words = self.words.take(pa.array(used))
        lists["words"] = pa.ListArray.from_arrays([0, len(words)], words)
        lists["langs"] = pa.array([list(self.langs[spans[0][0] : spans[0][1]])], pa.list_(pa.string()))
        batch = pa.RecordBatch.from_pydict(lists)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(batch)
        return sink.getvalue().to_pybytes()


def _read(segment: bytes) -> dict[str, pa.Array]:
    batch = pa.ipc.open_stream(segment).read_next_batch()
    return {name: batch.column(i).flatten() for i, name in enumerate(batch.schema.names)}


def merge(segments: list[bytes], path: tuple[str, ...], least: int = MIN_COUNT) -> Iterator[tuple[str, list[str], int, list[int | None]]]:
    """(lang, words, count, counts of the left parts of 1, 2, ... words) of the frequent nodes of one range.

    ``path`` is the cut point that the range begins with; left parts on it lie in earlier ranges: None.
    Level 0 is given whatever its count.
    """
    read = [_read(s) for s in segments]
    words = pa.chunked_array([r["words"] for r in read] + [pa.array(path[1:], pa.string())]).combine_chunks().dictionary_encode()
    langs = pa.chunked_array([r["langs"] for r in read] + [pa.array(path[:1], pa.string())]).combine_chunks().dictionary_encode()
    vocabulary, word_ids = words.dictionary, words.indices.to_numpy()
    lang_names, lang_ids = langs.dictionary.to_pylist(), langs.indices.to_numpy()
    word_at = np.concatenate(([0], np.cumsum([len(r["words"]) for r in read])))
    lang_at = np.concatenate(([0], np.cumsum([len(r["langs"]) for r in read])))
    width = len(vocabulary) + 1
    # Of the level above: for each segment the merged node of each of its nodes; -1: on the path, None: infrequent.
    above: list[np.ndarray] = []
    lefts: list[np.ndarray] = []  # of merged nodes above, the counts of their paths, -1 where unknown
    labels_above = np.zeros((0, 0), np.int64)
    lang_above = np.zeros(0, np.int64)
    for depth in range(DEPTH + 1):
        keys, counts, sizes = [], [], []
        for i, r in enumerate(read):
            level = r[f"level{depth}"]
            label, count = level.field("label").to_numpy(), level.field("count").to_numpy()
            if depth:
                parent = np.cumsum(level.field("step").to_numpy().astype(np.int64)) - 1
                # Merged parents from 2 on, the path is 1, infrequent ones are 0.
                merged = np.where(parent < 0, 1, above[i][np.maximum(parent, 0)] if len(above[i]) else 0)
                key = np.where(merged > 0, merged * width + word_ids[word_at[i] + label], 0)
            else:
                key = 1 + lang_ids[lang_at[i] + label]
            keys.append(key)
            counts.append(count)
            sizes.append(len(key))
        merged_keys, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(merged_keys), np.int64)
        np.add.at(total, inverse, np.concatenate(counts))
        frequent = (merged_keys > 0) & ((total >= least) if depth else True)
        number = np.where(frequent, np.cumsum(frequent) + 1, 0)
        above = np.split(number[inverse], np.cumsum(sizes)[:-1])
        merged_keys, total = merged_keys[frequent], total[frequent]
        parent, label = merged_keys // width, merged_keys % width
        if depth == 0:
            lang_here, labels_here = merged_keys - 1, np.zeros((len(total), 0), np.int64)
            left_here = np.zeros((len(total), 0), np.int64)
        else:
            # The path's own nodes come first: language, words and unknown counts.
            on_path = word_ids[len(word_ids) - len(path[1:]) :][: depth - 1]
            known = len(on_path) == depth - 1 and bool(path)
            path_labels = on_path[None] if known else np.full((1, depth - 1), -1)
            lang_all = np.concatenate(([lang_ids[-1] if path else -1], lang_above))
            labels_all = np.concatenate((path_labels, labels_above))
            left_all = np.concatenate((np.full((1, depth - 1), -1, np.int64), lefts[-1]))
            lang_here = lang_all[parent - 1]
            labels_here = np.concatenate((labels_all[parent - 1], label[:, None]), axis=1)
            left_here = left_all[parent - 1]
        names = vocabulary.take(pa.array(labels_here.ravel())).to_pylist()
        for i in range(len(total)):
            yield lang_names[lang_here[i]], names[i * depth : (i + 1) * depth], int(total[i]), [x if x >= 0 else None for x in left_here[i].tolist()]
        lang_above, labels_above = lang_here, labels_here
        lefts.append(np.concatenate((left_here, total[:, None]), axis=1) if depth else np.zeros((len(total), 0), np.int64))


def _text_parts(text: str, most: int) -> Iterator[str]:
    """A text cut between pieces into parts of about ``most`` characters."""
    at = 0
    while len(text) - at > most:
        ends = [k for c in ".,;:!?\n\x0b\x0c\r" if (k := text.find(c, at + most)) >= 0]
        if not ends:
            break
        yield text[at : min(ends) + 1]
        at = min(ends) + 1
    yield text[at:]


def cut_points(rows: DataFrame, cut_chars: int = CUT_CHARS) -> list[tuple[str, ...]]:
    """Sorted phrases (language, words) that split the corpus into ranges of about ``cut_chars`` characters of text.

    There are as many as tasks of a shuffle at least. They are quantiles of a bounded sample of phrases
    and bear on the balance of tasks alone. ``rows`` are (lang, text). At most CUTS of them stay.
    """
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("chars")).first()
    wanted = min(CUTS, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), size.chars // cut_chars))
    share = min(1.0, SAMPLE_ROWS / max(1, size.n))
    step = max(1, int(size.chars * share / 6 / SAMPLE_PHRASES))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column(0).to_pylist()
            ids, words, at = word_stream(b.column(1).to_pylist())
            out = []
            for place in range(b.num_rows % step, len(ids), step):
                phrase = []
                for k in range(place, min(place + DEPTH, len(ids))):
                    if ids[k] < 0 or at[k] != at[place]:
                        break
                    phrase.append(words[ids[k]].as_py()[:CUT_WORD_CHARS])
                if phrase:
                    out.append([langs[at[place]], *phrase])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string()))], ["phrase"])

    some = rows if share == 1 else rows.filter(F.rand(11) < share)
    phrases = {tuple(r.phrase) for r in some.mapInArrow(pick, "phrase array<string>").collect()}
    # Of equal phrases (a common passage) one remains, as each shard has one node for them.
    found = sorted(phrases, key=lambda p: [x.encode() for x in p])
    every = max(1, len(found) // (wanted + 1))
    return found[every::every][:wanted]


def frequent_phrases(
    docs: DataFrame, scratch: Scratch, lang_col: str = "lang", text_col: str = "text", least: int = MIN_COUNT, shard_chars: int = SHARD_CHARS, cut_chars: int = CUT_CHARS
) -> DataFrame:
    """(lang, words, f, lefts) of all phrases of up to DEPTH words that occur ``least`` times, and of the languages (no words).

    ``lefts`` are the counts of the first 1, 2, ... words.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(text_col, F.lit("")).alias("text"))
    cuts = cut_points(rows, cut_chars)
    known = spark.sparkContext.broadcast(cuts)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: list[str] = []
        texts: list[str] = []
        held = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for i, blob in Trie(langs, texts).segments(known.value):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([blob], pa.binary())], ["range", "segment"])

        for b in batches:
            for i in range(b.num_rows):
                lang = b.column(0)[i].as_py()
                for part in _text_parts(b.column(1)[i].as_py(), shard_chars):
                    langs.append(lang)
                    texts.append(part)
                    held += len(part)
                    if held >= shard_chars:
                        yield from rows()
                        langs, texts, held = [], [], 0
        if held:
            yield from rows()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, segments = None, []

        def rows() -> Iterator[pa.RecordBatch]:
            out = [(now, *row) for row in merge(segments, known.value[now - 1] if now else (), least)]
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, ["range", "lang", "words", "f", "lefts"])

        for b in batches:
            for i in range(b.num_rows):
                if (number := b.column(0)[i].as_py()) != now:
                    if segments:
                        yield from rows()
                    now, segments = number, []
                segments.append(b.column(1)[i].as_py())
        if segments:
            yield from rows()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = F.floor(F.col("range").cast("long") * parts / (len(cuts) + 1)).cast("int")
    sent = rows.mapInArrow(shard, "range int, segment binary").repartitionById(parts, own).sortWithinPartitions("range")
    nodes = scratch.table(sent.mapInArrow(merged, "range int, lang string, words array<string>, f long, lefts array<long>"), "nodes")
    if not cuts:
        return nodes.drop("range")
    # Counts on the paths to the cut points: at most DEPTH - 1 for each of at most CUTS ranges.
    paths = spark.createDataFrame(
        [(i + 1, k, c[0], list(c[1 : k + 1])) for i, c in enumerate(cuts) for k in range(1, min(len(c), DEPTH))] or [(0, 0, "", [])],
        "range int, k int, lang string, words array<string>",
    )
    found = paths.join(nodes.select("lang", "words", "f"), ["lang", "words"]).groupBy("range").agg(F.map_from_entries(F.collect_list(F.struct("k", "f"))).alias("path"))
    out = nodes.join(F.broadcast(found), "range", "left")
    lefts = F.transform("lefts", lambda x, k: F.coalesce(x, F.element_at("path", k + 1)))
    return out.select("lang", "words", "f", lefts.alias("lefts"))


def _phrase(words: Column) -> Column:
    return F.array_join(words, " ")


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = MIN_COUNT, top: int = TOP, cover_pct: int = COVER_PCT
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first ``top`` phrases of each language.

    A null text is empty, a null language is NO_LANG; repeated rows count each; ties end with the
    phrase's bytes, so ranks are unique; an empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    nodes = scratch.table(frequent_phrases(docs, scratch, lang_col, text_col, least), "frequent")
    key = F.struct("lang", "phrase").alias("key")
    phrases = nodes.filter(F.size("words") > 0).withColumn("phrase", _phrase(F.col("words")))
    # Suffix links, level by level: a phrase's right parts are its suffix and the suffix's right parts.
    linked = phrases.filter(F.size("words") == 1).select(key, F.col("f").alias("a"), F.array().cast("array<bigint>").alias("rights"))
    levels = []
    for depth in range(2, DEPTH + 1):
        suffix = F.struct("lang", _phrase(F.slice("words", 2, depth - 1)).alias("phrase")).alias("suffix")
        here = phrases.filter(F.size("words") == depth).select(key, "words", F.col("f").alias("a"), "lefts", suffix)
        down = linked.select(F.col("key").alias("suffix"), F.concat(F.array("a"), "rights").alias("rights"))
        linked = scratch.table(join_salted(here, down, "suffix", "key").drop("suffix"), f"linked-{depth}")
        levels.append(linked)
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    exact = lambda c: F.col(c).cast("decimal(20,0)") if isinstance(c, str) else c.cast("decimal(20,0)")
    ratio = lambda c: F.call_function("div", exact("a") * F.lit(SCALE), exact(c.lefts) + exact(c.rights))
    cuts = F.transform(F.arrays_zip("lefts", "rights"), lambda c, k: F.struct(ratio(c).alias("score"), k, c.lefts.alias("l"), c.rights.alias("r")))
    scored = every.select("key", "a", F.array_min(cuts).alias("cut"))
    # The most frequent longer candidate around each phrase.
    inner = [
        F.when(F.size("words") >= max(at + size - 1, size + 1), F.struct("key.lang", _phrase(F.slice("words", at, size)).alias("phrase")))
        for size in range(2, DEPTH)
        for at in range(1, DEPTH - size + 2)
    ]
    longer = every.select(F.explode(F.array_compact(F.array(*inner))).alias("key"), F.col("a").alias("longer"))
    covered = longer.groupBy("key").agg(F.max("longer").alias("longer"))
    kept = scored.join(covered, "key", "left").filter(F.coalesce(100 * exact("longer") < cover_pct * exact("a"), F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    out = kept.select("key.lang", "key.phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    langs = nodes.filter(F.size("words") == 0).select("lang", F.col("f").alias("n"))
    return out.join(langs, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words WHERE len(w) > 0), (VALUES (1), (2), (3), (4)) sizes(k)
  WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
  SELECT c.lang, c.k AS size, c.phrase, c.f AS a, j, l.f AS l, r.f AS r, CAST(2000000 * CAST(c.f AS HUGEINT) // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k > 1) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(string_split(c.phrase, ' ')[1:j], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(string_split(c.phrase, ' ')[j + 1:], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_parts AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + m - 1], ' ') AS phrase, max(f) AS longer
  FROM (SELECT *, unnest(range(1, k + 1)) AS i FROM f WHERE k > 2), (VALUES (2), (3)) sizes(m)
  WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
kept AS (
  SELECT l.* FROM lowest l LEFT JOIN inner_parts p ON p.lang = l.lang AND p.phrase = l.phrase
  WHERE p.longer IS NULL OR 100 * CAST(p.longer AS HUGEINT) < 80 * CAST(l.a AS HUGEINT)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
