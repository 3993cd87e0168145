"""Reading of scanned reports: what a document says about itself, repair of recognised text, glued words.

The repair rules are one chain of native replacements. Glued words are split with the corpus' own word counts: only distinct
unknown runs of letters are looked at; tasks hold the prices of the commonest words, rarer ones are joined, and the cheapest
splits of the runs of one length are found together in the task that holds them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boresight.functions.numeric import ft_to_m
from boresight.sources.tables import settled

# How the first page names the kind of a report, its bore, its date and the depth at six o'clock.
KINDS = (("DDR", r"(?i)DAILY\s*DRILLING"), ("WCR", r"(?i)COMPLETION"))
WELL = r"Well\s*:\s*Well\s*([A-Z](?:\s?[A-Z])?)(?![a-z])"
DATE = r"Date\s*:\s*(\d{1,2}-\w{3}-\d{4})"
DEPTH = r"Depth\s*@\s*06\s*:\s*00\s*:\s*([\d,.]+)\s*(m\s?MD|mtrs|m|ft|')"
# What recognition breaks and how it is written, in the order of the repairs. The fifth sets a depth's unit
# apart from the next word, for numbers of 100 and more with one point at most, unless unit and word are a unit's long name.
REPAIRS = (
    (r"(?<=\d)bb\s?[1l|I](?=\b|/|hr)", " bbl"),
    (r"\bbb\s?[1l|I](?=\b|/|hr)", "bbl"),
    (r"\b(8|12|17|26)(1/2|1/4)\"", '$1 $2"'),
    (r"(?<=\))\.(?=[A-Z])", ". "),
    (r"(?<!\d[,.]{0,8})((?=[0,]*[1-9](?:,*\d){2})\d[\d,]*+(?:\.[\d,]*+)?(?<=\d))\s?(?!(?i:mtrs|mtr|metres|meters|mts|mmd)(?![A-Za-z]))(m|ft)([a-z]{2,}[A-Za-z]*)", "$1 $2 $3"),
    (r"(?<=[a-z])(?=[A-Z][a-z])", " "),
    (r"(?<=[a-z]{2})(?=[A-Z]{2,})", " "),
    (r"(?<=[A-Za-z]{2})(?=\d)", " "),
    (r"(?<=\d)(?=[A-Za-z]{2,})", " "),
    (r"(?<=\d')(?=[A-Za-z])", " "),
    (r"(?<=[:;,)])(?=[A-Za-z(])", " "),
    (r"(?<=[A-Za-z])(?=\()", " "),
    (r"(?<=[a-z]{2})\.(?=[A-Z][a-z])|(?<=[A-Z]{2})\.(?=[A-Z][a-z])", ". "),
)
WORD = r"[A-Za-z]+(?:-[A-Za-z]+)?|\d+(?:[.,]\d+)*"
GLUED = r"[A-Za-z]{6,}"  # shorter runs of letters are left as they are
UNKNOWN, UNKNOWN_LETTER, SPARE = 12.0, 3.0, 6  # fixed values: price of a piece that is no word, and how much longer it may be than the longest word
COMMON, MOST_BITS = 200_000, 1 << 27  # words whose prices every task holds; bits of the bitmap of the others (16 MB)
CELLS = 1 << 22  # numbers that a task holds at a time in its matrices
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def document_meta(first_pages: DataFrame, wells: DataFrame) -> DataFrame:
    """What ``first_pages(doc_id, text)`` say: bore, whether text and id agree on it, kind, date, depth in metres.

    The bore is the part of ``doc_id`` before the first hyphen; where ``wells(well_id)`` doesn't hold it, the bore named in the
    text if that is held. A null text says nothing. Both look-ups are joins on the id, whose strategy is Spark's.
    """
    text = F.coalesce("text", F.lit(""))
    unless_empty = lambda c: F.nullif(c, F.lit(""))
    kind = F.when(text.rlike(KINDS[0][1]), KINDS[0][0]).when(text.rlike(KINDS[1][1]), KINDS[1][0]).otherwise("OTHER")
    value = F.regexp_replace(F.regexp_extract(text, DEPTH, 1), ",", "").try_cast("double")
    read = first_pages.select(
        "doc_id", F.split("doc_id", "-", 2)[0].alias("__file"), unless_empty(F.regexp_replace(F.regexp_extract(text, WELL, 1), r"\s", "")).alias("__told"), kind.alias("doc_type"),
        F.try_to_date(F.initcap(unless_empty(F.regexp_extract(text, DATE, 1))), "d-MMM-yyyy").alias("report_date"),
        F.when(F.regexp_extract(text, DEPTH, 2).isin("ft", "'"), ft_to_m(value)).otherwise(value).alias("header_depth"),
    )
    known = wells.select("well_id").distinct()
    for name in ("file", "told"):
        read = read.join(known.select(F.col("well_id").alias(f"__{name}"), F.lit(True).alias(f"__{name}_known")), f"__{name}", "left")
    well = F.when(F.col("__told_known") & F.col("__file_known").isNull(), F.col("__told")).otherwise(F.col("__file"))
    agree = F.when(F.col("__told").isNull(), "unreadable").when(F.col("__told") == well, "match").otherwise("mismatch")
    return read.select("doc_id", well.alias("well_id"), "doc_type", "report_date", "header_depth", agree.alias("identity_check"))


def repaired(line: Column) -> Column:
    """The text with what recognition breaks written as it is meant."""
    for pattern, new in REPAIRS:
        line = F.regexp_replace(line, pattern, new)
    return line


def word_counts(rows: DataFrame, text: str = "text") -> DataFrame:
    """How often each lower-cased word or number stands in well-read pages."""
    return rows.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def cheapest(length: int, known: dict[tuple[int, int], float], reach: int) -> list[int]:
    """Where the pieces of the least-cost split begin; ``known`` prices pieces (start, end), ties take the longer last piece."""
    costs, begins = [0.0], [0]
    for end in range(1, length + 1):
        cost, start = min((costs[s] + known.get((s, end), UNKNOWN + UNKNOWN_LETTER * (end - s)), s) for s in range(max(0, end - reach), end))
        costs.append(cost)
        begins.append(start)
    cuts, at = [], length
    while at > 0:
        at = begins[at]
        cuts.append(at)
    return cuts[::-1]


def _letters(words: list[str]) -> np.ndarray:
    """Lower-cased words of letters, all of one length, as a matrix: 1 to 26, a row a word."""
    return np.frombuffer("".join(words).lower().encode(), np.uint8).reshape(len(words), -1) - np.uint8(96)


def _by_length(words: list[str], cells: int) -> Iterator[np.ndarray]:
    """Places of words of one length, in parts of at most so many letters."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    for mine in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1) if len(order) else ():
        each = max(1, cells // max(1, int(sizes[mine[0]])))
        yield from (mine[i : i + each] for i in range(0, len(mine), each))


def _pieces(letters: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each of the ``lengths`` that fits, a 64-bit hash of every piece so long, by row and start."""
    wanted, made = set(lengths), np.zeros(letters.shape, np.uint64)
    for n in range(1, min(max(lengths, default=0), letters.shape[1]) + 1):
        made = made[:, : letters.shape[1] - n + 1] * _BASE + letters[:, n - 1 :]
        if n in wanted:
            mixed = (made ^ (made >> np.uint64(32))) * _MIX
            yield n, mixed ^ (mixed >> np.uint64(29))


def _places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """Three places of a hash in a bitmap of ``bits``, a power of two of 2^32 at most."""
    low, high = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32)
    return [((low + np.uint64(k) * high) & np.uint64(bits - 1)).astype(np.int64) for k in range(3)]


def _bitmap(words: DataFrame, bits: int, page: int = 1 << 16) -> np.ndarray:
    """A bitmap of ``words(word)``, made page by page on the executors; only its fixed size reaches the driver."""

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            mine, at = pdf["word"].tolist(), []
            for some in _by_length(mine, CELLS):
                letters = _letters([mine[i] for i in some])
                at += [p for _, h in _pieces(letters, [letters.shape[1]]) for p in _places(h[:, 0], bits)]
            at = np.concatenate([np.empty(0, np.int64), *at])
            yield pd.DataFrame({"page": at // page, "place": (at % page).astype(np.int32)})

    def drawn(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        mine = np.zeros(page, bool)
        mine[pdf["place"].to_numpy()] = True
        return pd.DataFrame({"page": [key[0]], "body": [np.packbits(mine).tobytes()]})

    pages = words.select("word").mapInPandas(places, "page long, place int").groupBy("page").applyInPandas(drawn, "page long, body binary").collect()
    whole = np.zeros(max(bits, page) // 8, np.uint8)
    for r in pages:
        whole[r.page * page // 8 : (r.page + 1) * page // 8] = np.frombuffer(r.body, np.uint8)
    return whole


class _Prices:
    """Costs of words of letters, found by the hashes of pieces and told apart by their letters."""

    def __init__(self, words: list[str], costs: np.ndarray):
        self.by_length = {}
        for mine in _by_length(words, 1 << 62):
            letters = _letters([words[i] for i in mine])
            n = letters.shape[1]
            hashes = next(h for _, h in _pieces(letters, [n]))[:, 0]
            order = np.argsort(hashes, kind="stable")
            drawn = np.zeros(1 << max(10, (8 * len(mine) - 1).bit_length()), bool)
            drawn[(hashes & np.uint64(len(drawn) - 1)).astype(np.int64)] = True
            self.by_length[n] = hashes[order], letters[order], costs[mine][order], drawn

    def of(self, n: int, hashes: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, start and cost of the pieces of ``n`` letters that are words."""
        if n not in self.by_length:
            return (np.empty(0, np.int64),) * 2 + (np.empty(0),)
        known, spelt, costs, drawn = self.by_length[n]
        row, start = np.nonzero(drawn[(hashes & np.uint64(len(drawn) - 1)).astype(np.int64)])
        found = hashes[row, start]
        left, right = np.searchsorted(known, found), np.searchsorted(known, found, "right")
        out = [(np.empty(0, np.int64),) * 2 + (np.empty(0),)]
        while (open_ := left < right).any():  # once, but for words of the same hash
            row, start, left, right = row[open_], start[open_], left[open_], right[open_]
            same = (letters[row[:, None], start[:, None] + np.arange(n)] == spelt[left]).all(axis=1)
            out.append((row[same], start[same], costs[left[same]]))
            left = left + 1
        return tuple(np.concatenate(x) for x in zip(*out))


def cheapest_of(letters: np.ndarray, prices: _Prices, lengths: list[int], reach: int, rarer: list) -> np.ndarray:
    """Where the last piece of the least-cost split of each beginning of each run begins, by row and length of the beginning: ``cheapest`` for runs of one length.

    ``rarer`` has for each run the pieces ``start, end, cost`` that ``prices`` does not know, or nothing.
    """
    runs, size = letters.shape
    wide = min(reach, size)
    unknown = UNKNOWN + UNKNOWN_LETTER * np.arange(wide, 0, -1)
    cost = np.broadcast_to(unknown, (runs, size + 1, wide)).copy()  # by row, end, and start less (end - wide)
    for n, hashes in _pieces(letters, [n for n in lengths if n <= wide]):
        row, start, price = prices.of(n, hashes, letters)
        cost[row, start + n, wide - n] = price
    for i, pieces in enumerate(rarer):
        for p in () if pieces is None else pieces:
            if p["end"] - p["start"] <= wide:
                cost[i, p["end"], wide - (p["end"] - p["start"])] = p["cost"]
    least, begins, every = np.full((runs, wide + size + 1), np.inf), np.zeros((runs, size + 1), np.int64), np.arange(runs)
    least[:, wide] = 0.0
    for end in range(1, size + 1):
        whole = least[:, end : end + wide] + cost[:, end]
        first = whole.argmin(axis=1)  # the first of equal ones: the longer last piece
        begins[:, end], least[:, wide + end] = end - wide + first, whole[every, first]
    return begins


def common_words(words: DataFrame, most: int = COMMON) -> tuple[DataFrame, DataFrame]:
    """The ``most`` commonest words of letters, ties by name, and the others."""
    letters = words.where(F.col("word").rlike("^[a-z]+$"))
    edge = letters.orderBy(F.desc("n")).select("n").limit(most).agg(F.count("*").alias("many"), F.min("n").alias("n")).first()
    if edge["many"] < most:
        return letters, letters.where("false")
    tied = letters.where(F.col("n") == edge["n"]).orderBy("word").limit(most - letters.where(F.col("n") > edge["n"]).count()).agg(F.max("word")).first()[0]
    held = (F.col("n") > edge["n"]) | ((F.col("n") == edge["n"]) & (F.col("word") <= tied))
    return letters.where(held), letters.where(~held)


def split_runs(runs: DataFrame, words: DataFrame, most: int = COMMON, bits: int = MOST_BITS) -> DataFrame:
    """``runs(run)`` of letters, distinct, with ``split``, their least-cost cut into ``words(word, n)``.

    A word costs minus the log of its share. The ``most`` commonest words go with the tasks, so their pieces are priced where
    the run is. Of the other pieces only those that a bitmap of the rarer words (``bits`` at most) lets through are made rows, and a
    join says which of them are words, so the split is exact however many words there are. A run is held whole by its task.
    """
    words = settled(words)
    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = runs.repartition(parts)  # short in bytes, so adaptive execution would leave them to a few tasks
    sums = words.agg(F.sum("n").alias("total"), F.max(F.length("word")).alias("longest"), F.collect_set(F.when(F.col("word").rlike("^[a-z]+$"), F.length("word"))).alias("lengths")).first()
    total, reach, lengths = sums["total"] or 1, (sums["longest"] or 1) + SPARE, sorted(sums["lengths"])
    price = (-F.log(F.col("n") / total)).alias("cost")
    often, rare = common_words(words, most)
    table = often.select("word", price).toArrow()  # at most ``most`` rows
    held_words, costs = table["word"].to_pylist(), table["cost"].to_numpy()
    prices = runs.sparkSession.sparkContext.broadcast((_Prices(held_words, costs), held_words, costs))
    n_rare = rare.count()

    priced = runs.select("run", F.lit(None).cast("array<struct<start:int,end:int,cost:double>>").alias("known"))
    if n_rare:
        size = min(bits, max(1 << 16, 1 << (16 * n_rare - 1).bit_length()))
        drawn = runs.sparkSession.sparkContext.broadcast(_bitmap(rare, size))

        def likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen = drawn.value
            held = lambda at: seen[at >> 3] >> (7 - (at & 7)) & 1
            for pdf in batches:
                mine = pdf["run"].tolist()
                for some in _by_length(mine, CELLS):
                    out = []
                    for n, hashes in _pieces(_letters([mine[i] for i in some]), lengths):
                        places = _places(hashes, size)
                        row, start = np.nonzero(held(places[0]))
                        for at in places[1:]:
                            good = held(at[row, start]).astype(bool)
                            row, start = row[good], start[good]
                        out += [(mine[i], s, s + n, mine[i][s : s + n].lower()) for i, s in zip(some[row].tolist(), start.tolist())]
                    yield pd.DataFrame(out, columns=["run", "start", "end", "word"])

        pieces = runs.mapInPandas(likely, "run string, start int, end int, word string")
        found = pieces.join(rare.select("word", price), "word").groupBy("run").agg(F.collect_list(F.struct("start", "end", "cost")).alias("known"))
        priced = runs.join(found, "run", "left").repartition(parts)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often, table = prices.value[0], None
        for pdf in batches:
            mine, rarer, out = pdf["run"].tolist(), pdf["known"].tolist(), [""] * len(pdf)
            for some in _by_length(mine, CELLS // 64):
                length = len(mine[some[0]])
                if length * min(reach, length) > CELLS:  # by one, in little memory
                    table = table or dict(zip(*prices.value[1:]))
                    for i in some:
                        low = mine[i].lower()
                        known = {(s, s + n): table[low[s : s + n]] for s in range(length) for n in lengths if s + n <= length and low[s : s + n] in table}
                        known.update({(p["start"], p["end"]): p["cost"] for p in (() if rarer[i] is None else rarer[i])})
                        begins = cheapest(length, known, reach)
                        out[i] = " ".join(mine[i][a:b] for a, b in zip(begins, [*begins[1:], length]))
                    continue
                last = cheapest_of(_letters([mine[i] for i in some]), often, lengths, reach, [rarer[i] for i in some]).tolist()
                for i, begins in zip(some.tolist(), last):
                    pieces, end = [], length
                    while end > 0:
                        pieces.append(mine[i][begins[end] : end])
                        end = begins[end]
                    out[i] = " ".join(pieces[::-1])
            yield pd.DataFrame({"run": pdf["run"], "split": out})

    return priced.mapInPandas(cut, "run string, split string")


def recovered(rows: DataFrame, words: DataFrame, key: list[str], text: str = "text", most: int = COMMON) -> DataFrame:
    """``rows`` with ``text`` repaired, and runs of letters that are no word of ``words`` split into words.

    Each row meets the splits of its own runs only. ``key`` names the row; rows of one key and any texts (null too) are borne.
    """
    words = settled(words)
    mended = rows.withColumn(text, repaired(F.col(text)))
    mended = settled(mended.withColumn("__runs", F.array_distinct(F.regexp_extract_all(text, F.lit(GLUED), F.lit(0)))))  # the repairs cost more than the rest
    own = mended.select(*key, F.explode("__runs").alias("run"))
    often = F.broadcast(common_words(words, most)[0].select(F.col("word").alias("__word")))  # most runs are common words and go here
    own = own.join(often, F.lower("run") == F.col("__word"), "left_anti")
    glued = settled(own.select("run").distinct().join(words.select(F.col("word").alias("__word")), F.lower("run") == F.col("__word"), "left_anti"))
    splits = settled(split_runs(glued, words, most).where("run <> split"))
    split = F.collect_set(F.struct("run", "split"))
    found = own.join(splits, "run").groupBy(*key).agg(split.alias("__splits"))
    found = found.select(*[F.col(k).alias(f"__k_{k}") for k in key], F.col("__splits.run").alias("__run"), F.col("__splits.split").alias("__split"))
    met = mended.drop("__runs").join(found, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in key], "left")
    return met.withColumn(text, F.pandas_udf(_rejoined, "string")(F.col(text), F.col("__run"), F.col("__split"))).select(*rows.columns)


def _rejoined(texts: pd.Series, runs: pd.Series, splits: pd.Series) -> pd.Series:
    """Texts with their runs as they are split; a text without splits, or null, is left as it is."""
    out = []
    for text, run, split in zip(texts, runs, splits):
        if text is not None and run is not None:
            known = dict(zip(run, split))
            text = re.sub(GLUED, lambda m: known.get(m[0], m[0]), text)
        out.append(text)
    return pd.Series(out, dtype=object)


def first_picks(records: DataFrame, tops: DataFrame, session: str = "session", slack: float = 2.0, block: float = 4.0) -> DataFrame:
    """Tops that the hole has passed by ``slack``: when, what was expected before, and the set of picks (``version``) from then on.

    ``records(session, t, hole_md)``, ``tops(session, code, md_top, md_prognosed)``. Expected is the prognosis moved by the
    shift of the pick before. Tops passed by a session's first record count as known from the start (``told`` is false).
    The first time at or below a depth is met from the deepest record up: within blocks of ``block`` metres, and over the blocks
    below by their least times, so records don't meet tops one by one and a hot session fills many tasks.
    """
    made = tops.select(session, "code", "md_top", "md_prognosed").distinct()
    top = F.struct("code", "md_top", "md_prognosed")
    asked = made.select(session, (F.col("md_top") + slack).cast("double").alias("__at"), F.lit(None).cast(records.schema["t"].dataType).alias("t"), top.alias("__top"))
    told = records.select(session, F.col("hole_md").cast("double").alias("__at"), "t", F.lit(None).cast(asked.schema["__top"].dataType).alias("__top"))
    both = asked.unionByName(told).where(F.col("__at").isNotNull() & F.col(session).isNotNull()).withColumn("__block", F.floor(F.col("__at") / block))
    below = Window.partitionBy(session).orderBy(F.desc("__block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = both.groupBy(session, "__block").agg(F.min("t").alias("__least")).withColumn("__below", F.min("__least").over(below)).drop("__least")
    up = Window.partitionBy(session, "__block").orderBy(F.desc("__at"), F.col("__top").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("__first", F.min("t").over(up)).where("__top IS NOT NULL").join(blocks, [session, "__block"])
    passed = met.select(session, "__top.*", F.least("__first", "__below").alias("t")).where("t IS NOT NULL")
    picked = passed.join(records.groupBy(session).agg(F.min("t").alias("__begin")), session)
    by_depth = Window.partitionBy(session).orderBy("md_top", "code")  # a row a top
    shift = F.lag(F.col("md_top") - F.col("md_prognosed"), 1, 0.0).over(by_depth)
    made = picked.withColumn("md_expected", F.col("md_prognosed") + shift).withColumn("version", F.row_number().over(by_depth))
    return made.withColumn("told", F.col("t") > F.col("__begin")).drop("__begin")


def add_version(records: DataFrame, picks: DataFrame, session: str = "session", block: float = 21600.0) -> DataFrame:
    """Adds ``version``, how many tops are picked by each record: the key under which a re-aligned track is looked up.

    Picks are counted along with the records in time order, within blocks of ``block`` seconds, and over the blocks before by
    their numbers of picks: linear in both, and a hot session fills many tasks.
    """
    row = F.struct(*records.columns)
    made = picks.where("t IS NOT NULL").select(session, F.col("t").alias("__t"), F.lit(1).alias("__pick"), F.lit(None).cast(records.select(row.alias("x")).schema["x"].dataType).alias("__row"))
    both = records.select(session, F.col("t").alias("__t"), F.lit(0).alias("__pick"), row.alias("__row")).unionByName(made).withColumn("__block", F.floor(F.col("__t") / block))
    before = Window.partitionBy(session).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = both.groupBy(session, "__block").agg(F.sum("__pick").alias("__n")).withColumn("__before", F.sum("__n").over(before)).drop("__n")
    so_far = Window.partitionBy(session, "__block").orderBy("__t", F.desc("__pick")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__own", F.sum("__pick").over(so_far)).where("__pick = 0").join(blocks, [session, "__block"], "left")
    return found.select("__row.*", (F.col("__own") + F.coalesce("__before", F.lit(0))).cast("int").alias("version"))
