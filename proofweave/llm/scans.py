"""Noise in text from scanned pages.

Rows are paragraphs (or the parts a page end leaves of them) with layout lines. The operator

* finds page furniture: stamps that come back at the top or bottom of a document's pages, and page numbers;
* counts a frequency lexicon of words, compounds and word bigrams over the body lines of the whole corpus
  (and of any clean paragraphs given with it), leaving out word fragments at layout breaks;
* decides for every line-end hyphen whether the layout broke a word, by the lexicon's counts of the joined
  word and of the compound;
* joins rare words to frequent ones through a symmetric-delete index (words that share a form after at most
  two deletions; words of a few letters, which would share too many, meet in their rewritings), keeps candidates whose weighted edit distance uses confusion pairs only, and picks the
  repair by frequency, distance and bigram context;
* joins lines, rows and pages into continuous paragraphs.

Everything but the parsing of single rows is a join or an aggregation. Rows of one document are never
gathered in one task: neighbours across rows are found within blocks of rows, then across blocks.

Defined results: repeated rows count once; null and blank texts have no lines; a row without a page is a page
of its own; lines are numbered as stored; a document of one page has no stamp (nothing comes back).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofweave.session import materialize

#: Body lines that may stand between furniture and the page's edge, and lines of a page's edge that are looked at.
GAP, EDGE = 2, 24
#: Pages on which a stamp must come back, and their least share of the document's pages.
STAMP_PAGES, STAMP_SHARE = 2, 0.15
#: Count from which a word is trusted as the right form of another, and by how many times it must prevail.
TRUSTED, PREVAILS = 4, 10
#: Commonest sound words that are not looked up again; a bounded list.
COMMON = 20_000
#: Rows of a block in which neighbours are sought.
BLOCK = 512
#: Length from which words are indexed by deletions, and up to which by rewritings.
LONG, SHORT = 5, 6
#: Cost of a confusion and the most a repair may cost.
CONFUSION, MOST = 0.5, 1.0

# What a recogniser reads for what is printed.
CONFUSIONS = (
    "1 l", "1 i", "1 I", "l 1", "l i", "i l", "I l", "l I", "| l", "| i", "| I", "! l", "! i", "j i", "i j", "0 o", "o 0", "0 O", "O 0", "5 s", "s 5", "5 S", "8 b", "8 B", "6 b", "9 g", "g 9", "9 q", "q g", "g q", "2 z", "4 a", "3 e", "7 t",
    "@ a", "c e", "e c", "o e", "e o", "o c", "c o", "a o", "o a", "h b", "b h", "f t", "t f", "i t", "t i", "l t", "t l", "r i", "u v", "v u", "u n", "n u", "v y", "y v", "n h", "h n", "k h", "f r",
    "rn m", "m rn", "in m", "m in", "ni m", "nn m", "iii m", "ri n", "n ri", "ii n", "ii u", "li u", "u li", "li h", "lh h", "vv w", "w vv", "cl d", "d cl", "c1 d", "ol d", "tl d", "fi h", "rt n", "lc k", "ti n", "th m", "fl ff", "tt n", "h li", "u ii", "n ii", "b li",
)
_PAIRS = frozenset(tuple(c.split(" ")) for c in CONFUSIONS)

_HYPHEN = r"[-‐‑¬\xad]"
_BREAK = re.compile(rf"([\w@|]+){_HYPHEN}\s*$")
_OPEN = re.compile(r"^\s*([\w@|]+)")
_TOKEN = re.compile(rf"[\w@|]+(?:{_HYPHEN}[\w@|]+|['’][\w@|]+)*")
_NUMBER = re.compile(r"(?:[lIO|](?=.*\d)|[SZBb](?=(?:.*\d){2})|\d)(?:[\dlIOoSZBb|]|[.,/](?=[\dlIOoSZBb]))*")


# --- furniture ------------------------------------------------------------------------------------------


def one_row_each(scans: DataFrame) -> DataFrame:
    """``doc_id, pos, page, text`` without repeated deliveries."""
    once = scans.select("doc_id", F.col("pos").cast("long").alias("pos"), "page", "text").dropDuplicates(["doc_id", "pos"])
    return once.withColumn("page", F.coalesce(F.col("page").cast("long"), -1 - F.col("pos")))


def stamp_key(line: Column) -> Column:
    """The part of a line that comes back on other pages: without brackets, a page number in it, case,
    spacing and common confusions; empty if no letters are left."""
    key = F.trim(F.regexp_replace(line, r"^\s*\[\s*(.*?)\s*\]\s*$", "$1"))
    for pattern in (r"^[\dlIO]{1,4}\s*\|\s*", r"\s*[/|]\s*[\dlIO]{1,4}$", r"\s{2,}[\dlIO]{1,4}\s+of\s+[\dlIO]{1,4}$", r"(?i)[\s,-]*\bp(?:age|\.)\s*\d{1,4}(?:\s*(?:of|/)\s*\d{1,4})?$"):
        key = F.regexp_replace(key, pattern, "")
    key = F.translate(F.lower(F.regexp_replace(key, r"\s+", "")), "015@|", "olsal")
    for read, printed in (("rn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "u"), ("ri", "n")):
        key = F.regexp_replace(key, read, printed)
    return F.when(key.rlike(r"\p{L}"), F.translate(key, "ic", "le")).otherwise(F.lit(""))


def page_number(line: Column, page: Column) -> Column:
    """Whether a line only gives the page; a bare number must be the row's own page."""
    dressed = line.rlike(r"(?i)^\s*(?:[\[(–—-]\s*(?:p(?:age|g)?\.?\s*)?[\dlIO]{1,4}\s*[\])–—-]|p(?:age|g)?\.?\s*[\dlIO]{1,4}(?:\s*(?:/|of|von|sur|de|di)\s*[\dlIO]{1,4})?|[\dlIO]{1,4}\s*(?:/|of)\s*[\dlIO]{1,4})\s*$")
    return dressed | (F.trim(line) == page.cast("string"))


def furniture(rows: DataFrame) -> DataFrame:
    """``doc_id, pos, line_no, noise`` for stamps (``header``) and page numbers (``page_no``).

    The cut to the edge lines of a page is made by rank filters, which Spark applies before the shuffle. Of
    these, a line counts that has at most :data:`GAP` lines between it and the edge that are no furniture
    themselves, so a letterhead of many lines is found whole.
    """
    lines = rows.select("doc_id", "page", "pos", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.trim(F.regexp_replace("line", r"\s+", " ")) != "")
    page = Window.partitionBy("doc_id", "page")
    top = lines.withColumn("n", F.row_number().over(page.orderBy("pos", "line_no"))).where(F.col("n") <= EDGE).withColumn("side", F.lit("top"))
    bottom = lines.withColumn("n", F.row_number().over(page.orderBy(F.desc("pos"), F.desc("line_no")))).where(F.col("n") <= EDGE).withColumn("side", F.lit("bottom"))
    running = F.col("line").rlike(r"^\s*\p{Ll}") & F.col("line").rlike(r"[.;,]\s*$")
    edge = top.unionByName(bottom).withColumn("is_no", page_number(F.col("line"), F.col("page"))).withColumn("key", F.when(F.col("is_no") | running, F.lit("")).otherwise(stamp_key(F.col("line"))))
    edge = materialize(edge, "edges")
    pages = rows.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"))

    def stamps(lines_: DataFrame) -> DataFrame:
        counted = lines_.where(F.col("key") != "").groupBy("doc_id", "key").agg(F.countDistinct("page").alias("on_pages")).join(pages, "doc_id")
        return counted.where((F.col("on_pages") >= STAMP_PAGES) & (F.col("on_pages") >= STAMP_SHARE * F.col("pages"))).select("doc_id", "key", F.lit(True).alias("stamp"))

    noise = F.when(F.col("is_no"), "page_no").when(F.col("stamp"), "header")
    marked = edge.join(stamps(edge), ["doc_id", "key"], "left").withColumn("noise", noise)
    nearer = Window.partitionBy("doc_id", "page", "side").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    near = marked.withColumn("between", F.coalesce(F.count_if(F.col("noise").isNull()).over(nearer), F.lit(0))).where(F.col("noise").isNotNull() & (F.col("between") <= GAP))
    # What comes back must come back at the edge: pages on which a line of the text repeats a stamp do not count.
    near = near.drop("stamp").join(stamps(near), ["doc_id", "key"], "left").where(F.col("is_no") | F.col("stamp"))
    return near.select("doc_id", "pos", F.col("line_no").cast("long").alias("line_no"), "noise").distinct()


# --- rows with their neighbours -------------------------------------------------------------------------


def body(text: str | None, skip: set[int]) -> list[tuple[int, str]]:
    """``(line_no, line)`` of the body lines of a row."""
    return [(k, x) for k, x in enumerate((text or "").split("\n")) if x.strip() and k not in skip]


def with_next(rows: DataFrame) -> DataFrame:
    """``rows`` with ``next``: the first body line of the next row of the document that has any."""

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, pos, text, skip in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                lines = body(text, set(skip or ()))
                if lines:
                    out.append({"doc_id": doc, "pos": pos, "at": lines[0][0], "line": lines[0][1]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.string()), ("pos", pa.int64()), ("at", pa.int64()), ("line", pa.string())]))

    first = rows.select("doc_id", "pos", "text", "skip").mapInArrow(firsts, "doc_id string, pos long, at long, line string")
    first = first.select("doc_id", "pos", F.struct("pos", "at", "line").alias("first"), F.floor(F.col("pos") / BLOCK).alias("block"))
    inner = first.withColumn("next", F.lead("first").over(Window.partitionBy("doc_id", "block").orderBy("pos")))
    heads = first.groupBy("doc_id", "block").agg(F.min_by("first", "pos").alias("head"))
    heads = heads.withColumn("after", F.lead("head").over(Window.partitionBy("doc_id").orderBy("block"))).drop("head")
    linked = inner.join(heads, ["doc_id", "block"]).select("doc_id", "pos", F.coalesce("next", "after").alias("next"))
    return rows.join(linked, ["doc_id", "pos"], "left")


def prepare(scans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows, furniture)``; rows hold ``doc_id, pos, page, text, skip, next`` and are written once."""
    rows = materialize(one_row_each(scans), "scan_rows")
    found = materialize(furniture(rows), "furniture")
    skips = found.groupBy("doc_id", "pos").agg(F.collect_list("line_no").alias("skip"))
    return materialize(with_next(rows.join(skips, ["doc_id", "pos"], "left")), "scan_body"), found


# --- lexicon --------------------------------------------------------------------------------------------


def parts(token: str) -> list[str]:
    """The words of a token without its hyphens, in lower case."""
    return [p.lower() for p in re.split(_HYPHEN, token) if p]


def breaks(lines: list[tuple[int, str]], after: dict | None) -> list[tuple[int, str, str, int]]:
    """``(index, left, right, start)`` of the lines that end in a hyphen, with the fragments on both sides and
    where the left one starts; index counts body lines."""
    out = []
    for k, (_, line) in enumerate(lines):
        m = _BREAK.search(line)
        follow = lines[k + 1][1] if k + 1 < len(lines) else (after or {}).get("line")
        o = _OPEN.match(follow) if m and follow else None
        if m and o:
            out.append((k, m.group(1), o.group(1), m.start(1)))
    return out


def line_words(lines: list[tuple[int, str]], after: dict | None, before_broken: bool = False) -> list[list[str]]:
    """Words of every body line in lower case, without fragments at line-end hyphens."""
    cut = {k: start for k, _, _, start in breaks(lines, after)}
    out = []
    for k, (_, line) in enumerate(lines):
        text = line[: cut[k]] if k in cut else line
        if k - 1 in cut or (k == 0 and before_broken):
            text = _OPEN.sub("", text, count=1)
        found: list[str] = []
        for t in _TOKEN.findall(text):
            found.extend(parts(t))
        out.append(found)
    return out


def lexicon(rows: DataFrame, clean: DataFrame | None = None) -> DataFrame:
    """``kind, key, n``: counts of words (``w``), compounds (``c``) and word bigrams (``b``)."""

    def tally(counts: Counter, lines: list[tuple[int, str]], after: dict | None, before_broken: bool) -> None:
        for (_, line), found in zip(lines, line_words(lines, after, before_broken), strict=True):
            for w in found:
                counts["w", w] += 1
            for a, b in zip(found, found[1:], strict=False):
                counts["b", a + " " + b] += 1
            for t in _TOKEN.findall(line):
                p = parts(t)
                for a, b in zip(p, p[1:], strict=False):
                    counts["c", a + "-" + b] += 1

    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in counts], pa.string()), pa.array([w for _, w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["kind", "key", "n"])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text, skip, after in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                # The first word may be the rest of one that the row before broke; it is not counted.
                tally(counts, body(text, set(skip or ())), after, True)
            if len(counts) > 200_000:
                yield batch_of(counts)
                counts = Counter()
        yield batch_of(counts)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                tally(counts, [(0, text or "")], None, False)
            if len(counts) > 200_000:
                yield batch_of(counts)
                counts = Counter()
        yield batch_of(counts)

    counts = rows.select("text", "skip", "next").mapInArrow(scanned, "kind string, key string, n long")
    if clean is not None:
        counts = counts.unionByName(clean.select("text").where(F.col("text").isNotNull()).mapInArrow(plain, "kind string, key string, n long"))
    return materialize(counts.groupBy("kind", "key").agg(F.sum("n").alias("n")), "lexicon")


# --- repairs --------------------------------------------------------------------------------------------


def deletes(word: str, most: int = 2) -> set[str]:
    """The word's forms after at most ``most`` deletions."""
    out = {word}
    for k in range(1, min(most, len(word) - 1) + 1):
        for drop in combinations(range(len(word)), k):
            out.add("".join(c for i, c in enumerate(word) if i not in drop))
    return out


def rewritings(word: str) -> set[str]:
    """Words that a short word can stand for after at most ``MOST / CONFUSION`` confusions."""
    out, last = {word}, {word}
    for _ in range(int(MOST / CONFUSION)):
        last = {w[:i] + printed + w[i + len(read) :] for w in last for read, printed in _PAIRS for i in range(len(w)) if w.startswith(read, i)}
        out |= last
    return out


def index_forms(word: str, asked: bool) -> set[str]:
    """Forms under which a word is looked up. Long words meet in their forms after deletions, which never fall below
    three characters; short ones, whose such forms would be shared by all, in their rewritings, marked ``=``."""
    out = deletes(word) if len(word) >= LONG else set()
    if len(word) <= SHORT:
        out |= {"=" + w for w in (rewritings(word) if asked else (word,))}
    return out


def confusion_distance(read: str, printed: str, limit: float = MOST) -> float:
    """Weighted edit distance in which only confusion pairs are allowed; infinite beyond ``limit``."""
    endless = float("inf")
    if read == printed:
        return 0.0
    rows = {(0, 0): 0.0}
    for i in range(len(read) + 1):
        for j in range(max(0, i - 3), min(len(printed), i + 3) + 1):
            cost = rows.get((i, j), endless)
            if cost > limit:
                continue
            if i < len(read) and j < len(printed) and read[i] == printed[j] and cost < rows.get((i + 1, j + 1), endless):
                rows[i + 1, j + 1] = cost
            for a in (1, 2, 3):
                for b in (1, 2):
                    if i + a <= len(read) and j + b <= len(printed) and (read[i : i + a], printed[j : j + b]) in _PAIRS and cost + CONFUSION < rows.get((i + a, j + b), endless):
                        rows[i + a, j + b] = cost + CONFUSION
    best = rows.get((len(read), len(printed)), endless)
    return best if best <= limit else endless


def _odd(word: Column) -> Column:
    """Whether a word mixes letters with digits or signs, which no sound word does."""
    return word.rlike(r"\p{L}") & word.rlike(r"[\d@|$€!]")


def repairs(counts: DataFrame, broken: DataFrame) -> DataFrame:
    """``word, candidate, cost, n``: every candidate repair of every doubtful word.

    ``broken`` holds ``word``: words joined across a layout break, which the lexicon has not counted.
    """
    words = counts.where("kind = 'w'").select(F.col("key").alias("word"), "n")
    joined = broken.select("word").distinct().join(words.select("word"), "word", "left_anti").select("word", F.lit(0).cast("long").alias("n"))
    trusted = words.where((F.col("n") >= TRUSTED) & F.col("word").rlike(r"^[\p{L}'’]{2,}$"))
    most = trusted.agg(F.coalesce(F.max("n"), F.lit(0)).alias("m")).first()["m"]  # one number
    doubtful = words.unionByName(joined).where((_odd(F.col("word")) | (F.col("n") * PREVAILS <= most)) & F.col("word").rlike(r"\p{L}") & (F.length("word") >= 2))

    def spell(batches: Iterator[pa.RecordBatch], is_asked: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, n = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(word), 2_000):
                forms = [(w, c, f) for w, c in zip(word[at : at + 2_000], n[at : at + 2_000], strict=True) for f in index_forms(w, is_asked)]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in forms], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["word", "n", "form"])

    index = trusted.mapInArrow(partial(spell, is_asked=False), "word string, n long, form string").select(F.col("word").alias("candidate"), F.col("n").alias("cn"), "form")
    asked = doubtful.mapInArrow(partial(spell, is_asked=True), "word string, n long, form string")
    prevails = (F.col("cn") >= F.col("n") * PREVAILS) | (_odd(F.col("word")) & (F.col("cn") >= F.col("n")))
    pairs = asked.join(index, "form").where((F.col("word") != F.col("candidate")) & prevails).select("word", "candidate", F.col("cn").alias("n")).distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cost = [confusion_distance(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cost), batch.column(2)], names=["word", "candidate", "cost", "n"])
            yield out.filter(pa.array([c <= MOST for c in cost], pa.bool_()))

    return materialize(pairs.mapInArrow(verify, "word string, candidate string, cost double, n long"), "repairs")


# --- lines ----------------------------------------------------------------------------------------------


def line_breaks(rows: DataFrame) -> DataFrame:
    """``doc_id, pos, line_no, left, right, next_pos, next_line_no, word, compound`` of lines that end in a
    hyphen."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, pos, text, skip, after in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                lines = body(text, set(skip or ()))
                for k, left, right, _ in breaks(lines, after):
                    to = (pos, lines[k + 1][0]) if k + 1 < len(lines) else (after["pos"], after["at"])
                    out.append((doc, pos, lines[k][0], left, right, *to))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=["doc_id", "pos", "line_no", "left", "right", "next_pos", "next_line_no"])

    found = rows.select("doc_id", "pos", "text", "skip", "next").mapInArrow(find, "doc_id string, pos long, line_no long, left string, right string, next_pos long, next_line_no long")
    return found.withColumn("word", F.lower(F.concat("left", "right"))).withColumn("compound", F.lower(F.concat_ws("-", "left", "right")))


def judged_breaks(found: DataFrame, counts: DataFrame, fixes: DataFrame) -> DataFrame:
    """``found`` with ``broken`` (the layout broke a word) and ``repair`` (of the joined word, or null)."""
    keys = (("w", F.col("word"), "n_word"), ("c", F.col("compound"), "n_compound"), ("w", F.lower("left"), "n_left"), ("w", F.lower("right"), "n_right"))
    distinct = found.select("word", "compound", "left", "right").distinct()
    wanted = distinct.select("word", "compound", "left", "right", F.inline(F.array(*[F.struct(F.lit(kind).alias("kind"), key.alias("key"), F.lit(name).alias("name")) for kind, key, name in keys])))
    got = wanted.join(counts, ["kind", "key"], "left").groupBy("word", "compound", "left", "right").agg(*[F.coalesce(F.max(F.when(F.col("name") == name, F.col("n"))), F.lit(0)).alias(name) for _, _, name in keys])
    best = best_repairs(fixes).select("word", F.col("candidate").alias("repair"))
    judged = got.join(best, "word", "left")
    letters = F.col("left").rlike(r"[\p{L}@|]$") & F.col("right").rlike(r"^[\p{Ll}@|\d]") & F.col("word").rlike(r"\p{L}")
    sound = (F.col("n_left") >= TRUSTED) & (F.col("n_right") >= TRUSTED) & (F.length("left") > 2) & (F.length("right") > 2)
    broken = F.when(F.col("n_compound") > F.col("n_word"), False).when((F.col("n_word") > 0) | F.col("repair").isNotNull(), True).otherwise(~sound)
    judged = judged.select("left", "right", (letters & broken).alias("broken"), F.when(letters & broken & (F.col("n_word") < TRUSTED), F.col("repair")).alias("repair"))
    return found.join(judged, ["left", "right"])


def best_repairs(fixes: DataFrame) -> DataFrame:
    """The likeliest candidate of every word: frequency against cost, ties by candidate."""
    order = Window.partitionBy("word").orderBy(F.desc(F.log(F.col("n").cast("double")) - 6 * F.col("cost")), "candidate")
    return fixes.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def doubtful_words(rows: DataFrame, counts: DataFrame, fixes: DataFrame) -> DataFrame:
    """``doc_id, pos, line_no, word, prev`` of words that have a repair, and of misread figures (``word`` is
    null). The commonest sound words, a bounded list, are left out before the join."""
    sound = counts.where("kind = 'w'").select(F.col("key").alias("word"), "n").join(fixes.select("word"), "word", "left_anti")
    common = {r["word"] for r in sound.orderBy(F.desc("n"), "word").limit(COMMON).select("word").collect()}
    sent = rows.sparkSession.sparkContext.broadcast(common)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skip_words = sent.value
        for batch in batches:
            out = []
            for doc, pos, text, skip, after, joined in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                lines = body(text, set(skip or ()))
                for (at, line), found in zip(lines, line_words(lines, after, bool(joined)), strict=True):
                    for k, w in enumerate(found):
                        if w not in skip_words and not w.isdigit():
                            out.append((doc, pos, at, w, found[k - 1] if k else ""))
                    if any(_misread_number(t) for t in re.findall(r"[\w|][\w|.,/]*", line)):
                        out.append((doc, pos, at, None, ""))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=["doc_id", "pos", "line_no", "word", "prev"])

    return rows.select("doc_id", "pos", "text", "skip", "next", "joined").mapInArrow(find, "doc_id string, pos long, line_no long, word string, prev string")


def _misread_number(token: str) -> bool:
    """A figure in which a letter stands for a digit."""
    token = token.strip(".,/")
    return bool(_NUMBER.fullmatch(token)) and not re.match(r"[A-Z]{2}", token) and any(c in "lIOoSZBb|" for c in token) and any(c.isdigit() for c in token)


def chosen_repairs(doubtful: DataFrame, counts: DataFrame, fixes: DataFrame) -> DataFrame:
    """``doc_id, pos, line_no, word, candidate``: the repair picked for every doubtful word of a line, by
    frequency, cost and how often the candidate follows the word before."""
    choices = doubtful.where(F.col("word").isNotNull()).join(fixes, "word")
    bigrams = counts.where("kind = 'b'").select("key", F.col("n").alias("together"))
    near = choices.withColumn("key", F.concat_ws(" ", "prev", "candidate")).join(bigrams, "key", "left")
    score = F.log(F.col("n").cast("double")) - 6 * F.col("cost") + 2 * F.log1p(F.coalesce("together", F.lit(0)).cast("double"))
    order = Window.partitionBy("doc_id", "pos", "line_no", "word").orderBy(F.desc(score), "candidate")
    return near.withColumn("k", F.row_number().over(order)).where("k = 1").select("doc_id", "pos", "line_no", "word", "candidate")


def _with_joined(rows: DataFrame, breaks_: DataFrame) -> DataFrame:
    """``rows`` with ``joined``: whether the row's first word is the rest of one that another row broke."""
    across = breaks_.where("next_pos <> pos").select("doc_id", F.col("next_pos").alias("pos"), F.lit(True).alias("joined")).distinct()
    return rows.join(across, ["doc_id", "pos"], "left")


class Scan:
    """All intermediate tables of a scanned corpus, each made once."""

    def __init__(self, scans: DataFrame, clean: DataFrame | None = None) -> None:
        rows, self.furniture = prepare(scans)
        self.counts = lexicon(rows, clean)
        found = materialize(line_breaks(rows), "breaks")
        self.fixes = repairs(self.counts, found)
        self.breaks = materialize(judged_breaks(found, self.counts, self.fixes), "judged")
        self.rows = _with_joined(rows, found)
        doubtful = materialize(doubtful_words(self.rows, self.counts, self.fixes), "doubtful")
        self.figures = doubtful.where("word is null").select("doc_id", "pos", "line_no")
        self.repairs = chosen_repairs(doubtful, self.counts, self.fixes)

    def noise(self) -> DataFrame:
        """``doc_id, pos, line_no, noise`` of every noisy line."""
        hyphens = self.breaks.where("broken").select("doc_id", "pos", "line_no", F.lit("hyphen").alias("noise"))
        # In a word broken by the layout the fragment that does not fit the repair is the misread one.
        fits = F.expr("startswith(repair, lower(left))")
        split = self.breaks.where("broken and repair is not null").select("doc_id", F.when(fits, F.col("next_pos")).otherwise(F.col("pos")).alias("pos"), F.when(fits, F.col("next_line_no")).otherwise(F.col("line_no")).alias("line_no"))
        misread = self.repairs.select("doc_id", "pos", "line_no").unionByName(self.figures).unionByName(split).distinct()
        return self.furniture.unionByName(hyphens).unionByName(misread.withColumn("noise", F.lit("misread"))).distinct()

    def paragraphs(self) -> DataFrame:
        """``doc_id, start_pos, first_page, last_page, text``: continuous repaired paragraphs."""
        mends = self.repairs.groupBy("doc_id", "pos").agg(F.collect_list(F.struct("line_no", "word", "candidate")).alias("mends"))
        joins = self.breaks.groupBy("doc_id", "pos").agg(F.collect_list(F.struct("line_no", "broken", "repair", "left", "right")).alias("joins"))
        full = self.rows.join(mends, ["doc_id", "pos"], "left").join(joins, ["doc_id", "pos"], "left")

        def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for doc, pos, page, text, skip, fixes, seams in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                    clean = mend_row(body(text, set(skip or ())), fixes or [], seams or [])
                    if clean:
                        out.append((doc, pos, page, clean))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=["doc_id", "pos", "page", "text"])

        rows = materialize(full.select("doc_id", "pos", "page", "text", "skip", "mends", "joins").mapInArrow(mend, "doc_id string, pos long, page long, text string"), "mended")
        return gather(rows)


def mend_row(lines: list[tuple[int, str]], fixes: list[dict], seams: list[dict]) -> str:
    """The row's text in one line; a word broken towards the next row keeps the mark U+0001 at its end, a
    compound divided there the mark U+0002."""
    by_line: dict[int, dict[str, str]] = {}
    for f in fixes:
        by_line.setdefault(f["line_no"], {})[f["word"]] = f["candidate"]
    seam = {s["line_no"]: s for s in seams}
    out = ""
    for k, (at, line) in enumerate(lines):
        text = re.sub(r"\s+", " ", line).strip()
        if at in by_line:
            text = re.sub(r"[\w@|]+", lambda m, own=by_line[at]: _like(m.group(0), own[m.group(0).lower()]) if m.group(0).lower() in own else m.group(0), text)
        text = re.sub(r"[\w|][\w|.,/]*", lambda m: m.group(0).translate(_DIGITS) if _misread_number(m.group(0)) else m.group(0), text)
        out += text
        s = seam.get(at)
        if s is not None:
            out = re.sub(rf"{_HYPHEN}\s*$", "\x01" if s["broken"] else "\x02", out)
        else:
            out += " "
    return re.sub("\x01(?!$)", "", re.sub("\x02(?!$)", "-", out.rstrip(" ")))


_DIGITS = str.maketrans("lIOoSZBb|", "110052861")


def _like(shape: str, word: str) -> str:
    """``word`` with the capitals of ``shape``."""
    return word.upper() if shape.isupper() and len(shape) > 1 else word[:1].upper() + word[1:] if shape[:1].isupper() else word


def gather(rows: DataFrame) -> DataFrame:
    """Rows joined into paragraphs. A row goes on with the paragraph before it if that one breaks off and a
    page ended in between. Starts are carried forward within blocks of rows, then across blocks."""
    block = F.floor(F.col("pos") / BLOCK)
    tail = F.struct("pos", "page", F.substring("text", -1, 1).alias("end"), F.col("page").alias("p"))
    rows = rows.withColumn("block", block)
    within = Window.partitionBy("doc_id", "block").orderBy("pos")
    last = rows.groupBy("doc_id", "block").agg(F.max_by(tail, F.col("pos")).alias("tail"))
    last = last.withColumn("before", F.lag("tail").over(Window.partitionBy("doc_id").orderBy("block"))).drop("tail")
    seen = rows.withColumn("prev", F.lag(tail).over(within)).join(last, ["doc_id", "block"]).withColumn("prev", F.coalesce("prev", "before")).drop("before")
    goes_on = F.col("prev").isNotNull() & (F.col("prev.page") != F.col("page")) & (~F.col("prev.end").rlike(r"[.!?:\"”)]"))
    goes_on = goes_on & (~F.col("text").rlike(r"^(?:\d{1,3}\.|\([a-z]\))\s"))
    seen = seen.withColumn("start", F.when(goes_on, F.lit(None)).otherwise(F.col("pos")))
    seen = seen.withColumn("near", F.last("start", True).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    carry = seen.groupBy("doc_id", "block").agg(F.max("start").alias("newest"))
    carry = carry.withColumn("far", F.last("newest", True).over(Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).drop("newest")
    placed = seen.join(carry, ["doc_id", "block"]).withColumn("start_pos", F.coalesce("near", "far", "pos"))
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    text = F.regexp_replace(F.regexp_replace(F.array_join(pieces, " "), "\x01 ?", ""), "\x02 ?", "-")
    return placed.groupBy("doc_id", "start_pos").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), text.alias("text"))
