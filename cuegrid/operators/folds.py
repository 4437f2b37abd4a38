"""Order-dependent folds: rules that look at what a block already holds, so no fixed set of windows gives them.

Folds without look-back run as SQL ``aggregate`` over sorted rows and only carry small state: over one cue's words,
or over a medium's cues as a scan of shares. Folds with look-back run as Arrow functions over one text or segment at a
time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuegrid.functions import text as X

# Limits of captions and of translation windows.
CAPTION_TARGET_MS, CAPTION_MAX_MS, CAPTION_CHARS, CAPTION_WORDS, LONG_GAP_MS = 4000, 5000, 84, 14, 450
TINY_BLOCK_MS = 1000
NATURAL_MIN, NATURAL_MAX = 4, 7
WINDOW_TARGET_MS, WINDOW_MAX_MS, WINDOW_CUES, WINDOW_SENTENCE_MS = 12_000, 18_000, 6, 6_000
SPACED_CHARS, UNSPACED_CHARS, SOFT_CLAUSE_CHARS, MIN_CUE_MS = 84, 24, 24, 1000


def _fold(items: Column, zero: dict[str, Column], step, kind: str, share: int = 256) -> Column:
    """struct<the fields of zero, outs>: an array folded by ``step(state, item)``, which appends to the state's field
    out. A share of the items at a time has its own out, so that no step copies what all before it have written."""
    nothing = F.expr(f"CAST(ARRAY() AS ARRAY<{kind}>)")
    shares = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / share).cast("int") - 1, F.lit(0))), lambda k: F.slice(items, k * share + 1, share))

    def one(a: Column, part: Column) -> Column:
        begun = F.struct(*(a[f].alias(f) for f in zero), nothing.alias("out"))
        done = F.array(F.aggregate(part, begun, step))  # an array of one, so that it is worked out once
        return F.transform(done, lambda d: F.struct(*(d[f].alias(f) for f in zero), F.array_append(a["outs"], d["out"]).alias("outs")))[0]

    start = F.struct(*(c.alias(f) for f, c in zero.items()), F.expr(f"CAST(ARRAY() AS ARRAY<ARRAY<{kind}>>)").alias("outs"))
    return F.aggregate(shares, start, one)


# A fold with few states runs over a medium of any length as a scan: rows are dealt into shares, each share becomes a
# map from the state before it to the state after it, and maps are composed, share by share inside groups and group by
# group, so that every share knows the state that it begins with.

#: Numbers of the order in a share, and shares in a group. An order below 2^31 makes 2^11 groups of a medium at most.
SHARE, GROUP = 256, 4096


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Both joined on keys of which any may be null."""
    renamed = b.withColumnsRenamed({k: f"_{k}" for k in keys})
    met = F.lit(True)
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return a.join(renamed, met).drop(*(f"_{k}" for k in keys))


def _composed(maps: Column, states: int) -> Column:
    """Maps (array<struct<to, n>> by the state before) one after the other; n adds up."""
    one = F.array(*(F.struct(F.lit(k).alias("to"), F.lit(0).cast("long").alias("n")) for k in range(states)))
    return F.aggregate(maps, one, lambda a, m: F.transform(a, lambda s: F.struct(m[s["to"]]["to"].alias("to"), (s["n"] + m[s["to"]]["n"]).alias("n"))))


def _entries(items: Column, state: Column, n: Column, at: str) -> Column:
    """array<struct<at, to, n>>: what each of the items (array<struct<at, map>>) begins with, after (state, n)."""
    kind = f"STRUCT<{at}: BIGINT, to: INT, n: BIGINT>"

    def step(a: Column, x: Column) -> Column:
        after = x["map"][a["to"]]
        entry = F.struct(x[at].alias(at), a["to"].alias("to"), a["n"].alias("n"))
        return F.struct(after["to"].alias("to"), (a["n"] + after["n"]).alias("n"), F.array_append(a["out"], entry).alias("out"))

    return F.flatten(_fold(items, {"to": state, "n": n}, step, kind, share=64)["outs"])


def scan(shares: DataFrame, key: str, states: int, group: int = GROUP) -> DataFrame:
    """(key, share, to, n) of shares (key, share, map): the state that each share begins with, and the sum of n before
    it. A key begins with state 0."""
    number = F.floor(F.col("share") / group).cast("long")
    listed = lambda at: F.sort_array(F.collect_list(F.struct(F.col(at).cast("long").alias(at), "map")))
    groups = shares.groupBy(key, number.alias("group")).agg(listed("share").alias("inner"))
    maps = groups.select(key, "group", _composed(F.transform("inner", lambda x: x["map"]), states).alias("map"))
    top = maps.groupBy(key).agg(listed("group").alias("all"))
    begun = top.select(key, F.explode(_entries(F.col("all"), F.lit(0), F.lit(0).cast("long"), "group")).alias("e")).select(key, "e.group", "e.to", "e.n")
    each = _same(groups, begun, [key, "group"])
    return each.select(key, F.explode(_entries(F.col("inner"), F.col("to"), F.col("n"), "share")).alias("e")).select(key, "e.share", "e.to", "e.n")


def _closes(lasts: int, n: int, sentence_end: bool) -> bool:
    """Whether a window closes after a cue: if, tested in this order, it lasts 18 s or has six cues; not under 6 s; at
    a sentence end; at 12 s."""
    if lasts >= WINDOW_MAX_MS or n >= WINDOW_CUES:
        return True
    return lasts >= WINDOW_SENTENCE_MS and (sentence_end or lasts >= WINDOW_TARGET_MS)


def window_steps(starts: list[int], ends: list[int], sentence_ends: list[bool], before: list[int], n: int) -> tuple[list[bool], int]:
    """(closed after each cue, cues that the last window has) of a share's cues. The state ``n`` is how many cues the
    open window has; ``before`` are the starts of the cues before the share, so it began at the n-th last of them."""
    closed, begun = [], before[-n] if 0 < n <= len(before) else 0
    for start, end, fin in zip(starts, ends, sentence_ends, strict=True):
        if not n:
            begun = start
        n += 1
        closed.append(_closes(end - begun, n, fin))
        n = 0 if closed[-1] else n
    return closed, n


_MAP = T.ArrayType(T.StructType([T.StructField("to", T.IntegerType()), T.StructField("n", T.LongType())]))


@F.pandas_udf(_MAP)
def _window_map(starts: pd.Series, ends: pd.Series, sentence_ends: pd.Series, before: pd.Series) -> pd.Series:
    """Each share's map: from every state to (state, windows closed)."""
    out = []
    for s, e, f, b in zip(starts, ends, sentence_ends, before, strict=True):
        runs = [window_steps(s, e, f, list(b), n) for n in range(WINDOW_CUES)]
        out.append([{"to": to, "n": sum(closed)} for closed, to in runs])
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _window_ids(starts: pd.Series, ends: pd.Series, sentence_ends: pd.Series, before: pd.Series, state: pd.Series, done: pd.Series) -> pd.Series:
    """The window of each cue of a share that begins with ``state``, after ``done`` windows."""
    out = []
    for s, e, f, b, n, d in zip(starts, ends, sentence_ends, before, state, done, strict=True):
        closed, _ = window_steps(s, e, f, list(b), n)
        ids, now = [], int(d) + 1
        for c in closed:
            ids.append(now)
            now += c
        out.append(ids)
    return pd.Series(out)


def translation_windows(cues: DataFrame, media: str = "media", order: str = "cue", share: int = SHARE, group: int = GROUP) -> DataFrame:
    """(media, window_id, start_ms, end_ms, n_cues, cue_first, cue_last, source_text). ``order`` is a whole number that
    no two cues of a medium share. A medium's cues lie in many shares: nothing holds them all."""
    one = F.struct(F.col(order).cast("long").alias("cue"), F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"), X.ends_sentence(F.col("text")).alias("sentence_end"), F.col("text").alias("text"))
    # Dealt by share, whatever the cues come dealt by; the branches below all read this one exchange.
    dealt = cues.select(media, F.floor(F.col(order) / share).cast("long").alias("share"), one.alias("one")).repartition(media, "share")
    packed = dealt.groupBy(media, "share").agg(F.sort_array(F.collect_list("one")).alias("c"))
    # A share has a cue at least, so the last five starts are among those of the five shares before.
    starts = packed.select(media, "share", F.transform(F.slice("c", F.greatest(F.size("c") - WINDOW_CUES + 2, F.lit(1)), WINDOW_CUES - 1), lambda x: x["start_ms"]).alias("last"))
    earlier = W.partitionBy(media).orderBy("share").rowsBetween(-(WINDOW_CUES - 1), -1)
    known = _same(packed, starts.select(media, "share", F.flatten(F.collect_list("last").over(earlier)).alias("before")), [media, "share"])
    parts = [F.transform("c", lambda x: x["start_ms"]), F.transform("c", lambda x: x["end_ms"]), F.transform("c", lambda x: x["sentence_end"]), F.col("before")]
    maps = known.select(media, "share", _window_map(*parts).alias("map"))
    begun = scan(maps, media, WINDOW_CUES, group)
    ids = _same(known, begun, [media, "share"]).select(media, "c", _window_ids(*parts, F.col("to"), F.col("n")).alias("ids"))
    flat = ids.select(media, F.explode(F.arrays_zip("c", "ids")).alias("x")).select(media, F.col("x.ids").alias("window_id"), "x.c.*")
    return flat.groupBy(media, "window_id").agg(F.min_by("start_ms", "cue").alias("start_ms"), F.max_by("end_ms", "cue").alias("end_ms"), F.count(F.lit(1)).alias("n_cues"), F.min("cue").alias("cue_first"), F.max("cue").alias("cue_last"), X.collapse_whitespace(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cue", "text"))), lambda t: t["text"]), " ")).alias("source_text"))


def natural_chunk_sizes(words: Column) -> Column:
    """Sizes of the natural-sentence chunks of an array of words: a chunk closes at seven words, at hard
    punctuation, or at soft punctuation from four words on; a rest of under four words joins the last chunk if
    both have seven at most."""
    hard, soft = (X.char_class(p) + "$" for p in (X.HARD_PUNCTUATION, X.SOFT_PUNCTUATION))

    def step(a: Column, w: Column) -> Column:
        n = a["n"] + 1
        close = (n >= NATURAL_MAX) | w.rlike(hard) | ((n >= NATURAL_MIN) & w.rlike(soft))
        return F.struct(F.when(close, 0).otherwise(n).alias("n"), F.when(close, F.concat(a["out"], F.array(n))).otherwise(a["out"]).alias("out"))

    def finish(a: Column) -> Column:
        out = F.flatten(a["outs"])
        last = F.try_element_at(out, F.lit(-1))
        joined = (F.size(out) > 0) & (a["n"] < NATURAL_MIN) & (last + a["n"] <= NATURAL_MAX)
        return F.when(a["n"] == 0, out).when(joined, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(last + a["n"]))).otherwise(F.concat(out, F.array(a["n"])))

    return F.transform(F.array(_fold(words, {"n": F.lit(0)}, step, "INT")), finish)[0]


def natural_captions(cues: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, chunk, start_ms, end_ms, text) of merged cues (start_ms, end_ms, text): equal slices, sentence case."""
    sized = cues.withColumn("w", X.tokens(F.col("text"))).where(F.size("w") > 0).withColumn("sizes", natural_chunk_sizes(F.col("w")))
    parts = sized.select(*keys, "start_ms", "end_ms", "w", "sizes", F.posexplode("sizes").alias("k", "size"))
    first = F.aggregate(F.slice("sizes", F.lit(1), F.col("k")), F.lit(0), lambda a, x: a + x)
    text = X.sentence_case(F.array_join(F.slice("w", first + 1, F.col("size")), " "))
    n = F.size("sizes")
    return parts.select(*keys, (F.col("k") + 1).alias("chunk"), X.even_slice(F.col("start_ms"), F.col("end_ms"), F.col("k"), n).alias("_s"), X.even_slice(F.col("start_ms"), F.col("end_ms"), F.col("k") + 1, n).alias("_e"), text.alias("text")).withColumnsRenamed({"_s": "start_ms", "_e": "end_ms"})


# --- folds with look-back, on plain Python values; the DataFrame forms follow ---

_STRONG = tuple(X.STRONG_BREAKS)


def _joined(words: list[dict]) -> str:
    return " ".join("".join(w["word"] for w in words).split())


def split_caption(words: list[dict]) -> list[list[dict]]:
    """Caption blocks of one segment's words (word with its leading space, start_ms, end_ms). A block takes words
    while it lasts 5 s, has 84 characters and 14 words at most; it ends early at a preferred break from 4 s on;
    when it overflows it goes back to its last preferred break, or else to the word before. A preferred break
    at the overflowing word itself replaces the one remembered, and then counts as the word before."""
    last = len(words) - 1

    def preferred(i: int) -> bool:
        return i >= last or words[i]["word"].strip().endswith(_STRONG) or words[i + 1]["start_ms"] - words[i]["end_ms"] >= LONG_GAP_MS

    blocks, begin = [], 0
    while begin <= last:
        remembered, end = None, last
        for i in range(begin, last + 1):
            taken = words[begin : i + 1]
            text = _joined(taken)
            if not text:
                continue
            good = preferred(i)
            if good:
                remembered = i
            lasts = max(0, taken[-1]["end_ms"] - taken[0]["start_ms"])
            if lasts <= CAPTION_MAX_MS and len(text) <= CAPTION_CHARS and sum(bool(w["word"].strip()) for w in taken) <= CAPTION_WORDS:
                if good and lasts >= CAPTION_TARGET_MS:
                    end = i
                    break
                continue
            end = remembered if remembered is not None else max(begin, i - 1)
            if end == i > begin:
                end -= 1
            break
        blocks.append(words[begin : end + 1])
        begin = end + 1
    return blocks


def merge_tiny(blocks: list[dict]) -> list[dict]:
    """Blocks (start_ms, end_ms, text, n_words, speaker) of under a second join the one before, if both have the
    same speaker and together keep the caption limits."""
    out: list[dict] = []
    for b in blocks:
        a = out[-1] if out else None
        if a and a["speaker"] == b["speaker"] and b["end_ms"] - b["start_ms"] < TINY_BLOCK_MS and len(f"{a['text']} {b['text']}") <= CAPTION_CHARS and b["end_ms"] - a["start_ms"] <= CAPTION_MAX_MS and a["n_words"] + b["n_words"] <= CAPTION_WORDS:
            out[-1] = a | {"end_ms": b["end_ms"], "text": f"{a['text']} {b['text']}".strip(), "n_words": a["n_words"] + b["n_words"]}
        else:
            out.append(dict(b))
    return out


def pseudo_words(text: str, start_ms: int, end_ms: int) -> list[dict]:
    """A segment without word times: its words share the time in equal slices."""
    parts = text.split()
    n = len(parts)
    at = lambda k: start_ms + (2 * (end_ms - start_ms) * k + n) // (2 * n)
    return [{"word": (" " if k else "") + w, "start_ms": at(k), "end_ms": at(k + 1)} for k, w in enumerate(parts)]


def captions_of(words: list[dict], text: str, start_ms: int, end_ms: int, speaker: str | None) -> list[dict]:
    """Caption blocks of one segment."""
    words = words or pseudo_words(text, start_ms, end_ms)
    if len(words) <= 1:
        collapsed = " ".join(text.split())
        return [{"start_ms": start_ms, "end_ms": end_ms, "text": collapsed, "n_words": len(words), "speaker": speaker}] if collapsed else []
    blocks = [{"start_ms": b[0]["start_ms"], "end_ms": b[-1]["end_ms"], "text": _joined(b), "n_words": sum(bool(w["word"].strip()) for w in b), "speaker": speaker} for b in split_caption(words)]
    return merge_tiny([b for b in blocks if b["text"]])


#: Rows of an Arrow batch that are Python values at once.
PYTHON_ROWS = 64


def row_parts(batches: Iterator[pa.RecordBatch], rows: int = PYTHON_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches in parts of a few rows: a batch has up to 10,000, whose nested values take many times their Arrow bytes
    as Python values."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def captions(segments: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, block, start_ms, end_ms, text, n_words, speaker) of segments (keys, start_ms, end_ms, text, speaker,
    words: array<struct<word, start_ms, end_ms>>, which may be null)."""
    kinds = dict(segments.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", block int, start_ms long, end_ms long, text string, n_words int, speaker string"
    made = [("block", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("text", pa.string()), ("n_words", pa.int32()), ("speaker", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_parts(batches):
            fields = pa.schema([*(batch.schema.field(k) for k in keys), *(pa.field(*f) for f in made)])
            rows = []
            for r in batch.to_pylist():
                blocks = captions_of(r["words"] or [], r["text"] or "", r["start_ms"], r["end_ms"], r["speaker"])
                rows += [{c: r[c] for c in keys} | {"block": k} | b for k, b in enumerate(blocks, 1)]
            yield pa.RecordBatch.from_pylist(rows, schema=fields)

    return segments.select(*keys, "start_ms", "end_ms", "text", "speaker", "words").mapInArrow(run, schema)


def segmentation_metadata(segments: DataFrame, blocks: DataFrame, media: str = "media") -> DataFrame:
    """(media, applied, source_segment_count, segment_count, used_word_timestamps, and the limits) of ``captions`` made
    of segments; a medium without a block has none of them."""
    given = segments.groupBy(media).agg(F.count(F.lit(1)).alias("source_segment_count"), F.bool_or(F.coalesce(F.size("words") > 0, F.lit(False))).alias("used_word_timestamps"))
    made = blocks.groupBy(media).agg(F.count(F.lit(1)).alias("segment_count"))
    limits = {"target_duration_seconds": CAPTION_TARGET_MS / 1000, "max_duration_seconds": CAPTION_MAX_MS / 1000, "max_characters": CAPTION_CHARS, "max_words": CAPTION_WORDS}
    return given.join(made, media, "left").select(media, F.lit(True).alias("applied"), "source_segment_count", F.coalesce("segment_count", F.lit(0)).alias("segment_count"), "used_word_timestamps", *(F.lit(v).alias(k) for k, v in limits.items()))


def clauses(text: str) -> list[str]:
    """Clauses of a translation: hard punctuation always closes one, soft punctuation from 24 characters on."""
    out, held = [], ""
    for c in text:
        held += c
        if c in X.HARD_PUNCTUATION or c in X.SOFT_PUNCTUATION and len(" ".join(held.split())) >= SOFT_CLAUSE_CHARS:
            out.append(" ".join(held.split()))
            held = ""
    out.append(" ".join(held.split()))
    return [x for x in out if x]


def wrapped(clause: str) -> list[str]:
    """A clause in lines of 84 characters, broken between words; without spaces in pieces of 24. A longer word
    stays whole."""
    words = clause.split()
    limit = SPACED_CHARS if len(words) > 1 else UNSPACED_CHARS
    if len(clause) <= limit:
        return [clause] if clause else []
    if len(words) == 1:
        return [clause[k : k + limit] for k in range(0, len(clause), limit)]
    lines = [words[0]]
    for w in words[1:]:
        if len(lines[-1]) + 1 + len(w) > limit:
            lines.append(w)
        else:
            lines[-1] += f" {w}"
    return lines


def long_enough(blocks: list[str], lasts_ms: int) -> list[str]:
    """Merges blocks until each gets a second of the window's time by its weight: the shortest (first of equals)
    joins its lighter neighbour, the left one on a tie."""
    blocks = list(blocks)
    weigh = lambda t: max(len("".join(t.split())), 1)
    while len(blocks) > 1:
        weights = [weigh(b) for b in blocks]
        least = min(weights)
        if lasts_ms * least >= MIN_CUE_MS * sum(weights):
            break
        j = weights.index(least)
        left = j > 0 and (j == len(blocks) - 1 or weights[j - 1] <= weights[j + 1])
        k = j - 1 if left else j
        blocks[k : k + 2] = [" ".join(f"{blocks[k]} {blocks[k + 1]}".split())]
    return blocks


def translated_blocks(windows: DataFrame, keys: tuple[str, ...], text: str = "translated_text") -> DataFrame:
    """(keys, block, start_ms, end_ms, text): each window's own times, and its text in blocks ready for ``islands.allocated``."""
    kinds = dict(windows.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", block int, start_ms long, end_ms long, text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                blocks = [line for c in clauses(r[-1] or "") for line in wrapped(c)]
                rows += [(*(getattr(r, c) for c in keys), k, r.start_ms, r.end_ms, b) for k, b in enumerate(long_enough(blocks, r.end_ms - r.start_ms), 1)]
            yield pd.DataFrame(rows, columns=[*keys, "block", "start_ms", "end_ms", "text"])

    return windows.select(*keys, "start_ms", "end_ms", text).mapInPandas(run, schema)
