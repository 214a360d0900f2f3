"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that also starts anywhere else are removed.

A suffix array over every byte would send each byte's suffix through the shuffle. Here the array is sparse: of each stretch of
``reach`` bytes one suffix stands for the windows that start there, the one whose first eight bytes have the smallest hash. Which
one that is follows from the stretch alone, so that equal windows (strings of ``length`` bytes) are stood for at the same place
in them, and the suffixes there share ``length - reach + 8`` bytes, their core.

1. Every suffix is sent as four tokens of its core, with a digest of all that its windows cover. Splitters from a bounded sample
   range-partition the suffixes by leading tokens, then by document, so that a core in a third of all documents is many buckets.
2. A bucket sorts its suffixes by multikey quicksort, one token after another within what the last one left tied, and compares
   neighbours. Groups at the two ends of a bucket are compared across boundaries, from one summary per bucket, core and digest.
3. A suffix alone in its group has no repeated window. Suffixes that agree in all that their windows cover are settled: all these
   windows are repeated. Only where a group holds different surroundings, as at the ends of a repeated passage, the windows of
   one suffix of each kind are compared one by one, by 96-bit digests, counted before the shuffle.
4. Each document marks what its repeated windows cover. All passes work on content; no text meets another one in a task.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from heddle.llm.common import give_back, pick, table, text_batches, written
from heddle.llm.words import mix

LENGTH = 400
REACH = 120  # bytes of a stretch that one suffix stands for: fewer make more suffixes, more make more windows to compare
TOKENS = 4
SEGMENT = 1 << 20  # bytes of texts taken at a time
BUCKET_ROWS, MOST_BUCKETS = 1 << 15, 1 << 19  # suffixes in a bucket, as long as there are no more buckets than these
SAMPLE_PER_BUCKET = 4  # suffixes that place the splitters

_LANE = 8
_FACTOR, _SEED = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

SETTLED, COMPARED, BOTH, OPEN, SUMMARY = 1, 2, 3, 4, 5


class _Suffixes:
    """The suffixes that stand for the windows of some stretches of texts.

    ``stretches`` are (number of the text, place in it, bytes), each with the starts of all windows but its last ``length - 1`` places.
    ``at`` are the suffixes' places in the joined bytes, ``low`` and ``high`` the first and last start of the windows that each stands
    for, ``text`` the number of its text, ``shift`` what leads from places here to places in the text.
    """

    def __init__(self, stretches: list[tuple[int, int, bytes]], length: int, reach: int):
        self.length, self.reach = length, reach
        self.data = b"".join(s for _, _, s in stretches)
        held = np.frombuffer(self.data + bytes(_LANE), np.uint8)
        n = len(held) - _LANE
        self.lanes = np.lib.stride_tricks.as_strided(held[:8].view(np.uint64), (n + 1,), (1,))
        h = self.lanes[: n - _LANE + 1] * _FACTOR
        h = (h ^ (h >> np.uint64(32))) * _SEED
        least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        width, size = reach - _LANE + 1, 1
        while size * 2 <= width:
            least, size = np.minimum(least[:-size], least[size:]), size * 2
        if size < width:
            least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
        sizes = np.array([len(s) for _, _, s in stretches])
        ends = np.cumsum(sizes)
        starts = np.ones(n, bool)
        for end in ends.tolist():
            starts[end - length + 1 : end] = False
        starts = np.flatnonzero(starts)
        at = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.append(True, at[1:] != at[:-1])  # no window reaches into another stretch
        self.at, self.low, self.high = at[new], starts[new], starts[np.append(new[1:], True)]
        stretch = np.searchsorted(ends, self.low, "right")
        self.text = np.array([k for k, _, _ in stretches])[stretch]
        self.shift = (np.array([place for _, place, _ in stretches]) - (ends - sizes))[stretch]

    def tokens(self) -> np.ndarray:
        """Each core as two numbers, of two tokens each."""
        per, out = (self.length - self.reach + _LANE) // (TOKENS * _LANE), []
        for k in range(TOKENS):
            h = np.full(len(self.at), _SEED)
            for lane in range(k * per, (k + 1) * per):
                h = mix(h * _FACTOR + self.lanes[self.at + lane * _LANE])
            out.append(h >> np.uint64(32))
        return np.stack([out[0] << np.uint64(32) | out[1], out[2] << np.uint64(32) | out[3]], axis=1)

    def kinds(self) -> np.ndarray:
        """A digest of the bytes that each one's windows cover, and of its place in them."""
        data, covered = self.data, (self.high + self.length).tolist()
        digests = [xxh3_64_intdigest(data[a:b], place) for a, b, place in zip(self.low.tolist(), covered, (self.at - self.low).tolist())]
        return np.array(digests, np.uint64).view(np.int64)


def suffixes(texts: Iterable[bytes], length: int, reach: int, segment: int = SEGMENT) -> Iterator[_Suffixes]:
    """All suffixes of texts, about ``segment`` bytes at a time; where a long text is parted follows from the text alone."""
    held, size = [], 0
    for k, data in enumerate(texts):
        starts = len(data) - length + 1
        for start in range(0, max(starts, 0), segment):
            held.append((k, start, data[start : min(start + segment, starts) + length - 1]))
            size += len(held[-1][2])
            if size >= segment:
                yield _Suffixes(held, length, reach)
                held, size = [], 0
    if held:
        yield _Suffixes(held, length, reach)


def multikey_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of numbers, and where in it each different row begins: one column after another is sorted, within the ties of those before."""
    order = np.argsort(keys[:, 0], kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = keys[order[1:], 0] != keys[order[:-1], 0]
    for column in range(1, keys.shape[1]):
        tied = np.flatnonzero(~new | ~np.append(new[1:], True))  # of stretches of two or more
        if not len(tied):
            break
        values = keys[order[tied], column]
        inner = np.lexsort((values, np.cumsum(new)[tied]))
        order[tied] = order[tied[inner]]
        values = values[inner]
        here = tied[1:][values[1:] != values[:-1]]
        new[here] = True
    return order, np.flatnonzero(new)


_ROW = {"bucket": "int", "t1": "long", "t2": "long", "doc": "long", "kind": "long", "n": "long"}


def _schema(columns: dict[str, str]) -> str:
    return ", ".join(f"{c} {t}" for c, t in columns.items())


def _of_texts(frames: Iterator[pd.DataFrame], length: int, reach: int, splitters: list[bytes]) -> Iterator[pd.DataFrame]:
    """A row for each suffix of a document and kind, with its bucket."""
    for frame in frames:
        ids = frame["doc"].to_numpy(np.int64)
        for held in suffixes((text.encode() for text in frame["text"]), length, reach):
            kinds = held.kinds()
            order = np.lexsort((kinds, held.text))
            text, kinds = held.text[order], kinds[order]
            new = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (kinds[1:] != kinds[:-1])))
            tokens, docs, kinds = held.tokens()[order[new]], ids[text[new]], kinds[new]
            n = np.diff(np.append(new, len(order)))
            bucket = np.zeros(len(docs), np.int32)
            if splitters:
                # big-endian and without signs, so that strings of bytes compare as the numbers do
                keys = np.column_stack([tokens, docs.view(np.uint64) ^ np.uint64(1 << 63)]).astype(">u8").tobytes()
                bucket = np.fromiter((bisect_right(splitters, keys[i : i + 24]) for i in range(0, len(keys), 24)), np.int32, len(docs))
            signed = tokens.view(np.int64)
            yield pd.DataFrame({"bucket": bucket, "t1": signed[:, 0], "t2": signed[:, 1], "doc": docs, "kind": kinds, "n": n})
    give_back()


def _compare(frame: pd.DataFrame) -> pd.DataFrame:
    """A bucket's suffixes in order: what their groups say about each, and the groups at the two ends, which may go on elsewhere."""
    tokens = np.ascontiguousarray(frame[["t1", "t2"]].to_numpy(np.int64)).view(np.uint64)
    order, begins = multikey_order(tokens)
    group = np.zeros(len(order), np.int64)
    group[order] = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(order))))
    frame = frame.assign(group=group)
    by_kind = frame.groupby(["group", "kind"], sort=False).agg(n=("n", "sum"), least=("doc", "min")).reset_index()
    by_kind["kinds"] = by_kind.groupby("group")["kind"].transform("size")
    by_kind["all"] = by_kind.groupby("group")["n"].transform("sum")
    by_kind["open"] = by_kind["group"].isin([0, len(begins) - 1])
    by_kind = by_kind[by_kind["open"] | (by_kind["all"] > 1)]
    rows = frame.drop(columns="n").merge(by_kind, on=["group", "kind"])
    rows["what"] = np.where(rows["open"], OPEN, _what(rows))
    ends = rows[rows["open"]].drop_duplicates(["group", "kind"]).assign(what=SUMMARY)
    return pd.concat([rows, ends.assign(doc=ends["least"])])[["what", "bucket", "t1", "t2", "doc", "kind", "n"]]


def _what(rows: pd.DataFrame) -> np.ndarray:
    repeated, several = rows["n"].to_numpy() > 1, rows["kinds"].to_numpy() > 1
    first = (rows["doc"] == rows["least"]).to_numpy()
    return np.select([repeated & several & first, repeated, several], [BOTH, SETTLED, COMPARED], 0)


def _across(found: DataFrame) -> DataFrame:
    """What holds for the suffixes at the ends of buckets, from the summaries of all of them."""
    summary = found.filter(F.col("what") == SUMMARY)
    kinds = summary.groupBy("t1", "t2", "kind").agg(F.sum("n").alias("n"), F.min("doc").alias("least"))
    groups = kinds.groupBy("t1", "t2").agg(F.count("*").alias("kinds"))
    told = summary.select("bucket", "t1", "t2", "kind").join(kinds, ["t1", "t2", "kind"]).join(groups, ["t1", "t2"])
    repeated, several, first = F.col("n") > 1, F.col("kinds") > 1, F.col("doc") == F.col("least")
    what = F.when(repeated & several & first, BOTH).when(repeated, SETTLED).when(several, COMPARED)
    rows = found.filter(F.col("what") == OPEN).select("bucket", "t1", "t2", "kind", "doc")
    return rows.join(told, ["bucket", "t1", "t2", "kind"]).select("doc", "kind", what.alias("what")).filter("what is not null")


def _splitters(rows: DataFrame, size: int, length: int, reach: int, buckets: int) -> list[bytes]:
    """Places between buckets, from the suffixes of a bounded number of documents; they only balance the buckets."""
    wanted = SAMPLE_PER_BUCKET * buckets
    share = min(1.0, 4 * wanted * reach / size)  # some more bytes than hold so many suffixes
    some = rows.filter(F.pmod(F.xxhash64(F.lit(11), "doc"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    seen = some.mapInPandas(lambda frames: _of_texts(frames, length, reach, []), _schema(_ROW)).select("t1", "t2", "doc")
    seen = seen.filter(F.pmod(F.xxhash64("t1", "t2", "doc"), F.lit(4)) == 0) if share == 1.0 and buckets > 64 else seen
    held = np.array([tuple(r) for r in seen.limit(wanted).collect()], np.int64).reshape(-1, 3).view(np.uint64)
    held[:, 2] ^= np.uint64(1 << 63)
    keys = sorted(row.astype(">u8").tobytes() for row in held)
    return [keys[i * len(keys) // buckets] for i in range(1, buckets)] if keys else []


def remove_repeated_bytes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    reach: int = REACH,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Columns ``id_col``, n_bytes, n_removed, spans (start and exclusive end of each removed run, in bytes), kept (binary).

    A byte of a text (as UTF-8) is removed if a string of ``length`` bytes covers it that starts anywhere else too: in
    another document, or elsewhere in the same one, whether they overlap or not. Strings are judged on the input; the first
    occurrence goes as well. ``length - reach`` must be 24 or more.

    Defined results: a null text counts as empty; texts shorter than ``length`` stay whole. Every row is a document of its
    own, rows that repeat (in id too) and rows without an id included. Kept bytes may begin or end within a character.
    Other columns are ignored; an empty table gives no rows. Long texts are taken apart in stretches of bounded length.
    """
    if length - reach + _LANE < TOKENS * _LANE or reach < _LANE:
        raise ValueError("length must exceed reach by 24 or more, reach must be 8 or more")
    text_batches(docs.sparkSession)
    rows = pick(docs, id=id_col, text=text_col).select(F.xxhash64("id", "text").alias("doc"), "id", F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    buckets = min(MOST_BUCKETS, max(1, 2 * size // reach // bucket_rows))
    splitters = _splitters(rows, size, length, reach, buckets) if buckets > 1 else []

    sent = rows.select("doc", "text").mapInPandas(lambda frames: _of_texts(frames, length, reach, splitters), _schema(_ROW))
    columns = {"what": "int"} | _ROW
    found = written(sent.groupBy("bucket").applyInPandas(_compare, _schema(columns)), "suffixes")
    told = found.filter(F.col("what").isin(SETTLED, COMPARED, BOTH)).select("doc", "kind", "what").unionByName(_across(found))
    kinds = lambda *of: F.collect_set(F.when(F.col("what").isin(*of), F.col("kind")))
    told = written(told.groupBy("doc").agg(kinds(SETTLED, BOTH).alias("settled"), kinds(COMPARED, BOTH).alias("compared")), "told")

    def windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame[[x is not None and len(x) > 0 for x in frame["compared"]]]
            ids, wanted = frame["doc"].to_numpy(np.int64), frame["compared"].tolist()
            for held in suffixes((text.encode() for text in frame["text"]), length, reach):
                kinds, parts = held.kinds(), []
                for text, a, b in _by_text(held):
                    here = a + np.flatnonzero(np.isin(kinds[a:b], wanted[text]))
                    parts.append(here[np.unique(kinds[here], return_index=True)[1]])  # one of each kind
                sent = np.concatenate(parts)
                n = held.high[sent] - held.low[sent] + 1
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                data, at = held.data, (np.repeat(held.low[sent], n) + place).tolist()
                digests = np.frombuffer(b"".join([xxh3_128_digest(data[p : p + length]) for p in at]), np.int32).reshape(-1, 4)
                h1 = np.ascontiguousarray(digests[:, :2]).view(np.int64).ravel()
                doc, kind = ids[held.text[sent]], kinds[sent]
                yield pd.DataFrame({"doc": np.repeat(doc, n), "kind": np.repeat(kind, n), "place": place.astype(np.int32), "h1": h1, "h2": digests[:, 2]})
        give_back()

    # the same exchange of texts serves both joins
    with_kinds = rows.join(told, "doc", "left").select("doc", "id", "text", "settled", "compared")
    compared = with_kinds.mapInPandas(windows, "doc long, kind long, place int, h1 long, h2 int")
    again = compared.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    places = compared.join(again, ["h1", "h2"]).groupBy("doc").agg(F.collect_set(F.struct("kind", "place")).alias("places"))
    # places arrive as two lists, which Arrow hands over faster than structs
    places = written(places.select("doc", F.col("places.kind").alias("kinds"), F.col("places.place").alias("places")), "places")

    def remove(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [text.encode() for text in frame["text"]]
            runs = _repeated(texts, *(frame[c].tolist() for c in ("settled", "kinds", "places")), length, reach)
            out = []
            for k, data in enumerate(texts):
                starts, ends = runs.get(k, ([], []))
                kept = b"".join(data[a:b] for a, b in zip([0, *ends], [*starts, len(data)]))
                out.append((len(data), len(data) - len(kept), starts, ends, kept))
            yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "starts", "ends", "kept"]).assign(id=frame["id"].to_numpy())
        give_back()

    id_type = rows.schema["id"].dataType.simpleString()
    marked = with_kinds.select("doc", "id", "text", "settled").join(places, "doc", "left")
    kept = marked.mapInPandas(remove, f"id {id_type}, n_bytes long, n_removed long, starts array<long>, ends array<long>, kept binary")
    spans = F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end"))
    return kept.select(F.col("id").alias(id_col), "n_bytes", "n_removed", spans.alias("spans"), "kept")


def _by_text(held: _Suffixes) -> Iterator[tuple[int, int, int]]:
    """Each text's number and stretch of suffixes."""
    edges = np.flatnonzero(np.diff(held.text)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(held.text)]):
        yield int(held.text[a]), a, b


def _repeated(texts: list[bytes], settled: list, own: list, place: list, length: int, reach: int) -> dict[int, tuple[list[int], list[int]]]:
    """Starts and ends of the runs of each text that repeated windows cover: all windows of settled kinds, single places of others."""
    some = [k for k in range(len(texts)) if settled[k] is not None and len(settled[k]) or own[k] is not None and len(own[k])]
    covered: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for held in suffixes((texts[k] for k in some), length, reach):
        kinds, low, high = held.kinds(), held.low + held.shift, held.high + held.shift
        for n, a, b in _by_text(held):
            k, found = some[n], covered.setdefault(some[n], [])
            if settled[k] is not None and len(settled[k]):
                whole = a + np.flatnonzero(np.isin(kinds[a:b], settled[k]))
                found.append((low[whole], high[whole] + length))
            if own[k] is not None and len(own[k]):
                of = np.asarray(own[k], np.int64)
                by_kind = np.argsort(of, kind="stable")
                places, of = np.asarray(place[k], np.int64)[by_kind], of[by_kind]
                first, last = np.searchsorted(of, kinds[a:b], "left"), np.searchsorted(of, kinds[a:b], "right")
                for i in np.flatnonzero(last > first).tolist():
                    at = low[a + i] + places[first[i] : last[i]]
                    found.append((at, at + length))
    out = {}
    for k, parts in covered.items():
        low, high = (np.concatenate(p) for p in zip(*parts))
        if len(low):
            order = np.argsort(low, kind="stable")
            low, high = low[order], np.maximum.accumulate(high[order])
            new = np.append(True, low[1:] > high[:-1])
            out[k] = low[new].tolist(), high[np.append(new[1:], True)].tolist()
    return out


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove from every document all bytes covered by strings of 400 bytes that also start elsewhere."""
    kept = remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
  SELECT k, i, count(*) OVER (PARTITION BY m) AS n
  FROM (SELECT k, i, md5_number(substr(h, 2 * i + 1, {2 * LENGTH})) AS m
        FROM (SELECT k, h, unnest(range(0, len(h) // 2 - {LENGTH} + 1)) AS i FROM texts WHERE len(h) >= {2 * LENGTH}))),
edges AS (SELECT k, i, i > lag(i, 1, -{LENGTH} - 1) OVER (PARTITION BY k ORDER BY i) + {LENGTH} AS opens FROM windows WHERE n > 1),
runs AS (
  SELECT k, min(i) AS a, max(i) + {LENGTH} AS b
  FROM (SELECT k, i, sum(opens::INT) OVER (PARTITION BY k ORDER BY i) AS run FROM edges) GROUP BY k, run),
gaps AS (
  SELECT k, b AS a, lead(a) OVER (PARTITION BY k ORDER BY a) AS b FROM runs
  UNION ALL SELECT k, 0, min(a) FROM runs GROUP BY k),
left_over AS (
  SELECT k, string_agg(substr(h, 2 * a + 1, CASE WHEN b IS NULL THEN len(h) ELSE 2 * (b - a) END), '' ORDER BY a) AS h
  FROM gaps JOIN texts USING (k) GROUP BY k),
counts AS (SELECT k, count(*) AS n_spans, sum(b - a) AS n_removed FROM runs GROUP BY k)
SELECT doc_id, len(texts.h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(from_hex(coalesce(left_over.h, texts.h))) AS kept_sha256
FROM texts LEFT JOIN counts USING (k) LEFT JOIN left_over USING (k)
"""
