"""Line deduplication by a segment-partition edit join, in DataFrame functions only.

Two lines within edit distance t: cut the shorter into t + 1 segments, then one of them occurs unchanged in the
longer (pigeonhole). Each line's segments are indexed with its length; each line probes, for every length
l in [L - t, L], the substrings of itself that can be an untouched segment of a line of length l. The starts
are bounded by the edits left of the segment and right of it, (t^2 - (L-l)^2) / 2 + t + 1 in all. t follows from
the shorter line's length: one edit for each full ten characters, two at most, so lines of under ten characters
are compared exactly. Lines that share a mark (a segment at a length) are verified by a bit-parallel edit distance
of a band of 2t + 1 diagonals, on what lies between the common beginning and the common end, once their counts
of frequent characters are as close as the edits can bring them.

Lines are joined once each (distinct lines), so copies cost nothing. Marks are counted before any text moves;
the lines of a mark meet in blocks of bounded size, in as many passes as it takes for a pass to move about as many
characters as all lines have, and what comes out is a row for each line with its number of links, so no pair of
lines is ever a row. A line is dropped if an earlier place (by doc_id, then place in the text)
has the same line or one within the distance. Lines are told apart by 64-bit hashes of their trimmed text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrayloom.llm._common import cut, cut_counted, shuffles_dropped, unused, written

#: Edits that two lines may differ by at most, and the characters that allow one.
EDITS, CHARS = 2, 10
#: Lines of a mark that are compared at once, and shared marks up to which their table is broadcast (beyond, it is shuffled).
BLOCK, BROADCAST_ROWS = 128, 200_000
#: Words of 64 bits that the filter of more shared marks has at most: four marks a word up to four million of them.
WORDS, MARKS_A_WORD = 1 << 20, 4
#: Characters that a pass may move in any case, and what is counted for a moved line besides its own.
PASS_CHARS, ROW_CHARS = 1 << 26, 64
#: Shared marks of a pass at most: the filter then has eight a word.
PASS_MARKS = 1 << 23
#: What is known of a line in a block.
MEMBER = ("cls", "line", "size", "first", "part")
#: Frequent characters whose counts are compared before the lines are.
COUNTED = " etaoinsrhldcumfpgwy"
#: Columns of the band after which a distance that can't stay within the edits is given up.
LOOK = 24
#: What is trimmed off a line.
BLANKS = " \t\r\x0b\x0c"
#: Places of lines in a text, as a factor of the id in a sortable place.
LINES = 1 << 31


def _begin(length: Column, k: Column, edits: Column | int) -> Column:
    """Where segment k of t + 1 of a line begins (from 0): the last segments get the characters left over."""
    return (F.call_function("div", length, edits + F.lit(1)) * k + F.greatest(F.lit(0), length % (edits + F.lit(1)) - (edits + F.lit(1) - k))).cast("int")


def counts(line: Column) -> Column:
    """How often some frequent characters occur, each modulo 8 in three bits."""
    each = [(F.length(line) - F.length(F.replace(line, F.lit(c)))).bitwiseAND(F.lit(7)).cast("bigint") * F.lit(1 << (3 * k)) for k, c in enumerate(COUNTED)]
    return reduce(lambda x, y: x + y, each)


def close_counts(a: Column, b: Column, edits: int) -> Column:
    """Whether two lines' counts are as close as the edits allow: each takes one character and puts one."""
    total = F.lit(0)
    for k in range(len(COUNTED)):
        apart = (F.shiftrightunsigned(a, 3 * k) - F.shiftrightunsigned(b, 3 * k)).bitwiseAND(F.lit(7).cast("bigint"))
        total = total + F.least(apart, 8 - apart)
    return total <= 2 * edits


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether the edit distance of two texts is at most ``edits``: bit-parallel over a band, in one fold.

    Bit k of a column j stands for row j - t + k. The vertical differences of the column before are kept as
    two words; the distance is followed down the band's last diagonal, then along the last row.
    """
    t, mask = edits, (1 << (2 * edits + 1)) - 1
    shape = "struct<vp:bigint,vn:bigint,score:int>"

    def run(p: Column) -> Column:  # p: the longer's and the shorter's characters
        x, y = p["x"], p["y"]
        m = F.size(x)

        def step(s: Column, j: Column) -> Column:
            here = F.get(y, j - 1)
            same = [F.when(F.get(x, F.when(j - t + k >= 1, j - t + k - 1).otherwise(m)) == here, F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for k in range(2 * t + 1)]
            match = same[0]
            for bit in same[1:]:
                match = match.bitwiseOR(bit)
            bound = F.array(F.struct(match.alias("pm"), s["vp"].alias("vp"), s["vn"].alias("vn"), s["score"].alias("score"), j.alias("j")))
            zeroed = F.transform(bound, lambda v: F.struct((((v["pm"].bitwiseAND(v["vp"]) + v["vp"]).bitwiseXOR(v["vp"])).bitwiseOR(v["pm"]).bitwiseOR(v["vn"])).bitwiseAND(F.lit(mask).cast("bigint")).alias("d0"), v.alias("v")))

            def finish(z: Column) -> Column:
                v, d0 = z["v"], z["d0"]
                full = F.lit(mask).cast("bigint")
                hp = v["vn"].bitwiseOR(full.bitwiseXOR(d0.bitwiseOR(v["vp"])))
                hn = d0.bitwiseAND(v["vp"])
                down = F.shiftright(d0, 1)
                row = t + m - v["j"]  # the bit of the last row, if the band has come to it
                along = F.call_function("shiftright", hp, row).bitwiseAND(F.lit(1).cast("bigint")) - F.call_function("shiftright", hn, row).bitwiseAND(F.lit(1).cast("bigint"))
                diagonal = 1 - F.shiftright(d0, 2 * t).bitwiseAND(F.lit(1).cast("bigint"))
                score = v["score"] + F.when(v["j"] <= m - t, diagonal).otherwise(along).cast("int")
                return F.struct(hn.bitwiseOR(full.bitwiseXOR(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"), score.alias("score")).cast(shape)

            return F.get(F.transform(zeroed, finish), 0)

        # column 0: rows 1 to t + 1 rise by one each; its score is that of row min(t, m)
        start = F.struct(F.lit(((1 << (t + 1)) - 1) << t).cast("bigint").alias("vp"), F.lit(0).cast("bigint").alias("vn"), F.least(F.lit(t), m).alias("score")).cast(shape)
        n = F.size(y)

        def rest(s: Column) -> Column:
            # the column's values, from the row of the score upwards: one above the edits in all rows can't come back
            value, least = s["score"], s["score"]
            for k in range(2 * t - 1, -1, -1):
                bit = lambda word, k=k: F.shiftright(s[word], k).bitwiseAND(F.lit(1).cast("bigint"))
                value = value - bit("vp") + bit("vn")
                least = F.least(least, value)
            over = (n > LOOK) & (m > LOOK + t) & (least > t)
            more = F.aggregate(F.sequence(F.lit(LOOK + 1), n), s, step)["score"] <= t
            return F.when(over, F.lit(False)).when(n > LOOK, more).otherwise(s["score"] <= t)

        first = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(LOOK))), start, step)
        folded = F.get(F.transform(F.array(first), rest), 0)
        return F.when(m - n > t, F.lit(False)).when(n == 0, m <= t).otherwise(folded)

    longer, shorter = F.when(F.length(a) >= F.length(b), a).otherwise(b), F.when(F.length(a) >= F.length(b), b).otherwise(a)
    letters = lambda s: F.when(F.length(s) > 0, F.split(s, "", -1)).otherwise(F.array().cast("array<string>"))
    # bind the arrays, then what is left without the common beginning, then without the common end
    bound = F.array(F.struct(letters(longer).alias("x"), letters(shorter).alias("y")))
    first_differs = lambda p: F.array_position(F.zip_with(p["x"], p["y"], lambda u, v: u.eqNullSafe(v)), False)

    def trimmed(p: Column) -> Column:
        # zip_with pads the shorter with nulls: only equal texts have no difference
        n = F.when(first_differs(p) > 0, first_differs(p) - 1).otherwise(F.size(p["x"])).cast("int")
        tail = lambda c: F.slice(c, n + 1, F.greatest(F.size(c) - n, F.lit(0)))
        return F.struct(F.reverse(tail(p["x"])).alias("x"), F.reverse(tail(p["y"])).alias("y"))

    return F.get(F.transform(F.transform(F.transform(bound, trimmed), trimmed), run), 0)


def allowed(size: Column, edits: int, chars: int) -> Column:
    """Edits that a line of ``size`` characters may be away: one for each full ``chars`` characters, ``edits`` at most."""
    return F.least(F.lit(edits), F.call_function("div", size, F.lit(chars)).cast("int"))


def shifts(k: int, less: int, edits: int) -> range:
    """Where an untouched segment k of a line ``less`` characters shorter can be: k edits at most lie before it, edits - k behind it."""
    return range(max(-k, less - (edits - k)), min(k, less + (edits - k)) + 1)


def _places(edits: int, least: int) -> Column:
    """All (edits, segment, characters that the indexed line is shorter, shift) for ``least`` edits or more."""
    found = [(t, k, less, s) for t in range(least, edits + 1) for less in range(t + 1) for k in range(t + 1) for s in shifts(k, less, t)]
    return F.array(*[F.struct(*[F.lit(x).alias(c) for x, c in zip(place, ("t", "k", "less", "shift"), strict=True)]) for place in found])


def with_marks(lines: DataFrame, edits: int, chars: int) -> DataFrame:
    """A row for each mark of each line, with ``own``: whether it is one of the line's own segments.

    Which lengths go with which number of edits follows from the shorter line, the indexed one. A mark is a
    hash of that line's length and the text at the place, with the segment's number in its last three bits.
    Places that don't fit into the line have none; a line may have a mark twice.
    """
    # one short expression for each row: an array of all marks would make a method too large to be compiled
    top = F.col("size") >= edits * chars + edits
    each = lines.select("*", F.explode(F.when(top, _places(edits, edits)).otherwise(_places(edits, 1))).alias("at"))
    each = each.select(*lines.columns, "at.*").withColumn("indexed", F.col("size") - F.col("less")).where(allowed(F.col("indexed"), edits, chars) == F.col("t"))
    each = each.withColumns({"begin": _begin(F.col("indexed"), F.col("k"), F.col("t")), "next": _begin(F.col("indexed"), F.col("k") + 1, F.col("t"))})
    start, width = F.col("begin") + F.col("shift"), F.col("next") - F.col("begin")
    each = each.where((start >= 0) & (start + width <= F.col("size")))
    mark = F.xxhash64("indexed", F.substring("line", start + 1, width)).bitwiseAND(F.lit(-8).cast("bigint")).bitwiseOR(F.col("k").cast("bigint"))
    return each.select(*lines.columns, mark.alias("mark"), ((F.col("less") == 0) & (F.col("shift") == 0)).alias("own"))


def _word(mark: Column, words: int) -> Column:
    """The word of the filter that a mark is in; ``words``: a power of two."""
    return F.shiftrightunsigned(mark, 21).bitwiseAND(F.lit(words - 1).cast("bigint"))


def _bits(mark: Column) -> Column:
    """The bits that a mark sets in its word: three at most."""
    each = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(mark, k).bitwiseAND(F.lit(63).cast("bigint")).cast("int")) for k in (3, 9, 15)]
    return reduce(lambda x, y: x.bitwiseOR(y), each)


def among(marked: DataFrame, shared: DataFrame, n: int) -> DataFrame:
    """The rows of ``marked`` whose mark is one of the ``n`` of ``shared``, and parts.

    A few shared marks are broadcast. Of more, a filter of bounded size is, so that the join shuffles the lines at
    shared marks and about one in a hundred others, not each line at each of its marks.
    """
    if n <= BROADCAST_ROWS:
        return marked.join(F.broadcast(shared), "mark")
    words = min(WORDS, 1 << max(0, (-(-n // MARKS_A_WORD) - 1).bit_length()))
    held = shared.groupBy(_word(F.col("mark"), words).alias("word")).agg(F.bit_or(_bits(F.col("mark"))).alias("bits"))
    # an inner join: a semi join would be pushed below the marks, which then were made several times
    maybe = marked.join(F.broadcast(held), (_word(F.col("mark"), words) == F.col("word")) & (F.col("bits").bitwiseAND(_bits(F.col("mark"))) == _bits(F.col("mark"))))
    return maybe.select(*marked.columns).join(shared, "mark")


def _occurs(i: Column, p: Column, k: Column, edits: int) -> Column:
    """Whether segment k of line i stands in the longer line p where an untouched one can."""
    begin, after = _begin(i["size"], k, edits), _begin(i["size"], k + 1, edits)
    width, less = after - begin, p["size"] - i["size"]
    part = F.substring(i["line"], begin + 1, width)
    places = F.sequence(F.greatest(-k, less - (edits - k)), F.least(k, less + (edits - k)))
    return F.exists(places, lambda s: (begin + s >= 0) & (F.substring(p["line"], begin + s + 1, width) == part))


def _linked(i: Column, p: Column, k: Column, edits: int, chars: int) -> Column:
    """Whether the line i, by its segment k, and the longer one p (of equals that with the greater hash) are within the edits.

    True for the first segment of i that p has only, so that a pair counts once however many marks it shares.
    """

    def near(t: int) -> Column:
        before = F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))
        first = _occurs(i, p, k, t) & ~F.exists(before, lambda j: _occurs(i, p, j, t))
        return (p["size"] - i["size"] <= t) & close_counts(i["counts"], p["counts"], t) & first & within(p["line"], i["line"], t)

    out = F.lit(False)
    for t in range(1, edits + 1):
        out = F.when(allowed(i["size"], edits, chars) == t, near(t)).otherwise(out)
    return ((p["size"] > i["size"]) | ((p["size"] == i["size"]) & (p["cls"] > i["cls"]))) & out


def _tallied(block: Column, own: Column, mark: Column, across: Column, edits: int, chars: int) -> Column:
    """For the lines of a block of one mark: array<struct<cls, n, earliest>>, links of each and the first place of the linked ones.

    ``own``: the lines whose own segment it is. ``across``: only lines of different parts are compared.
    """
    k = mark.bitwiseAND(F.lit(7).cast("bigint")).cast("int")
    # counted here, behind the shuffle: in one stage with the marks it would make a method too large to be compiled
    counted = F.transform(block, lambda x: F.struct(*[x[c].alias(c) for c in MEMBER], counts(x["line"]).alias("counts")))
    bound = F.transform(F.array(counted), lambda b: F.struct(F.filter(b, lambda x: F.array_contains(own, x["cls"])).alias("i"), b.alias("p")))

    def meet(v: Column) -> Column:
        return F.struct(v["i"].alias("i"), v["p"].alias("p"), F.transform(v["p"], lambda p: F.transform(v["i"], lambda i: (~across | (i["part"] != p["part"])) & _linked(i, p, k, edits, chars))).alias("m"))

    def tally(v: Column) -> Column:
        row = lambda cls, hits, firsts: F.struct(cls.alias("cls"), F.size(F.filter(hits, lambda h: h)).cast("bigint").alias("n"), F.array_min(F.zip_with(hits, firsts, lambda h, f: F.when(h, f))).alias("earliest"))
        first_i, first_p = F.transform(v["i"], lambda i: i["first"]), F.transform(v["p"], lambda p: p["first"])
        ups = F.zip_with(v["p"], v["m"], lambda p, hits: row(p["cls"], hits, first_i))
        downs = F.transform(v["i"], lambda i, j: row(i["cls"], F.transform(v["m"], lambda hits: F.get(hits, j)), first_p))
        return F.filter(F.concat(ups, downs), lambda r: r["n"] > 0)

    return F.get(F.transform(F.transform(bound, meet), tally), 0)


def lines_of(docs: DataFrame) -> DataFrame:
    """A row for each line: doc_id, text_hash, line_no (from 0), line (trimmed), cls (null for empty lines and rows with a null id)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "line"))
    own = own.withColumn("line", F.btrim("line", F.lit(BLANKS)))
    return own.withColumn("cls", F.when((F.length("line") > 0) & F.col("doc_id").isNotNull(), F.xxhash64("line")))


def _place() -> Column:
    return F.col("doc_id").cast("decimal(20,0)") * F.lit(LINES).cast("decimal(11,0)") + F.col("line_no")


def distinct_lines(docs: DataFrame) -> DataFrame:
    """cls, line, size, first (place), places of the distinct lines, written to the shared folder."""
    lines = lines_of(docs).where("cls is not null")
    own = lines.groupBy("line").agg(F.min(_place()).alias("first"), F.count("*").alias("places"))
    with shuffles_dropped(docs.sparkSession):
        return written(own.select(F.xxhash64("line").alias("cls"), "line", F.length("line").alias("size"), "first", "places"))


def link_counts(own: DataFrame, edits: int = EDITS, chars: int = CHARS, block: int = BLOCK) -> DataFrame:
    """cls, n_links, earliest for the ``distinct_lines`` that have others within the edits: their number and their first place.

    Marks that two lines share are counted first. Only their lines are brought together, in blocks of about
    ``block``; the blocks of a mark meet two at a time, each meeting in a task of its own, and give a row for
    each line that has links there, not for each pair. Where the lines of all shared marks have more characters
    than the table, meetings are dealt to passes; a pass's shuffle files go when its rows are written.
    """
    if not 1 <= edits < 8 or chars <= edits:
        raise ValueError("edits must be 1 to 7, and fewer than the characters that allow one")
    long = own.where(F.col("size") >= chars)
    # the lines of a mark are of nearly one size, below zero if it is a line's own: one column says both
    sized = F.when(F.col("own"), -F.col("size")).otherwise(F.col("size"))
    marks = with_marks(long.select("line", "size"), edits, chars).groupBy("mark").agg(F.count("*").alias("n"), F.min(sized).alias("sized"))
    parts = F.ceil(F.col("n") / block).cast("int")
    moved = (F.col("n") * parts * (ROW_CHARS - F.col("sized"))).cast("double")
    with shuffles_dropped(own.sparkSession):
        shared, n = cut_counted(marks.where("n > 1 and sized < 0").select("mark", parts.alias("parts"), moved.alias("moved")))
    passes = _passes(own, shared, n)
    marked = with_marks(long.select("cls", "line", "size", "first"), edits, chars)
    if passes == 1:
        return _met(marked, shared.select("mark", "parts"), n, edits, chars)
    rows = []
    for k in range(passes):
        with shuffles_dropped(own.sparkSession):
            here = shared.where((F.col("parts") > 1) | (_pass(F.lit(0), F.lit(0), passes) == k)).select("mark", "parts")
            rows.append(written(_met(marked, here, here.count(), edits, chars, (k, passes))))
    return reduce(DataFrame.unionByName, rows).groupBy("cls").agg(F.sum("n_links").alias("n_links"), F.min("earliest").alias("earliest"))


def _passes(own: DataFrame, shared: DataFrame, n: int) -> int:
    """Passes in which no more than the characters of ``own`` are moved, nor more marks than the filter can tell apart."""
    if not n:
        return 1
    moved, all_chars = shared.agg(F.sum("moved")).first()[0], own.agg(F.sum(F.col("size").cast("long"))).first()[0]
    return max(1, -(-int(moved) // max(all_chars, PASS_CHARS)), -(-n // PASS_MARKS))


def _pass(x: Column, y: Column, passes: int) -> Column:
    """The pass in which parts x and y of a mark meet."""
    return F.pmod(F.xxhash64("mark", x.cast("int"), y.cast("int")), F.lit(passes).cast("bigint"))


def _met(marked: DataFrame, shared: DataFrame, n: int, edits: int, chars: int, only: tuple[int, int] | None = None) -> DataFrame:
    """cls, n_links, earliest of the meetings at the ``n`` marks of ``shared``; ``only``: those of one pass, and the number of passes."""
    members = among(marked, shared, n)
    members = members.withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    met = members.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    x, y = F.least("part", "other"), F.greatest("part", "other")
    if only:
        met = met.where(_pass(x, y, only[1]) == only[0])
    met = met.groupBy("mark", x.alias("x"), y.alias("y")).agg(F.collect_set(F.struct(*MEMBER)).alias("lines"), F.collect_set(F.when(F.col("own"), F.col("cls"))).alias("own"))
    rows = met.select(F.explode(_tallied(F.col("lines"), F.col("own"), F.col("mark"), F.col("x") != F.col("y"), edits, chars)).alias("r"))
    return rows.groupBy("r.cls").agg(F.sum("r.n").alias("n_links"), F.min("r.earliest").alias("earliest"))


def judged(docs: DataFrame, edits: int = EDITS, chars: int = CHARS) -> DataFrame:
    """Each line's place with what becomes of it: doc_id, text_hash, line_no, again, near, n_links.

    ``again``: an earlier place has the same line. ``near``: an earlier place has another line within the
    distance. ``n_links``: distinct other lines within the distance. Empty lines have none of them.
    """
    own = distinct_lines(docs)
    linked = own.select("cls", "first").join(link_counts(own, edits, chars), "cls")
    repeated = own.where("places > 1").select("cls", "first", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("decimal(31,0)").alias("earliest"))
    found = linked.unionByName(repeated).groupBy("cls").agg(F.min("first").alias("first"), F.max("n_links").alias("n_links"), F.min("earliest").alias("earliest"))
    with shuffles_dropped(docs.sparkSession):
        found = cut(found)
    out = lines_of(docs).select("doc_id", "text_hash", "line_no", "cls").join(found, "cls", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return out.select("doc_id", "text_hash", "line_no", yes(_place() > F.col("first")).alias("again"), yes(F.col("earliest") < F.col("first")).alias("near"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def line_report(docs: DataFrame, edits: int = EDITS, chars: int = CHARS) -> DataFrame:
    """doc_id, n_lines, n_again, n_near, n_links, n_kept, lines_kept for every distinct (doc_id, text) of ``docs``.

    n_again lines repeat an earlier line exactly, n_near others are within the edits of an earlier line;
    n_links sums, over the lines, the distinct other lines within that distance; lines_kept lists the numbers
    of the lines that stay. Null texts are empty: one empty line. Empty lines (trimmed) and those of rows with a
    null id always stay. Rows that repeat an id with its text are one. Texts and lines of any length are read
    whole. An empty table gives no rows; other columns are ignored.
    """
    found = judged(docs, edits, chars)
    gone = F.col("again") | F.col("near")
    rows = found.groupBy("doc_id", "text_hash").agg(
        (F.max("line_no") + 1).cast("long").alias("n_lines"),
        F.count("*").alias("places"),
        F.sum(F.col("again").cast("long")).alias("n_again"),
        F.sum((F.col("near") & ~F.col("again")).cast("long")).alias("n_near"),
        F.sum("n_links").alias("n_links"),
        F.sort_array(F.collect_set(F.when(~gone, F.col("line_no")))).alias("lines_kept"),
    )
    # rows that repeat an id with its text have given each line as often
    once = [F.call_function("div", F.col(c) * F.col("n_lines"), F.col("places")).alias(c) for c in ("n_again", "n_near", "n_links")]
    return rows.select("doc_id", "n_lines", *once, F.size("lines_kept").cast("long").alias("n_kept"), "lines_kept")


def drop_lines(docs: DataFrame, edits: int = EDITS, chars: int = CHARS) -> DataFrame:
    """``docs`` with the repeated and near-repeated lines taken out of ``text`` (and ``n_chars``, if it is there, set anew).

    Rows that lose lines and keep none, or empty ones alone, go; all other rows and columns stay. Null and empty
    texts and rows with a null id stay as they are; rows that repeat an id with its text lose the same lines.
    """
    gone = judged(docs, edits, chars).where("again or near")
    id_, hash_, lines = (unused(docs, c) for c in ("gone_id", "gone_hash", "gone_lines"))
    gone = gone.groupBy(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).agg(F.sort_array(F.collect_set("line_no")).alias(lines))
    joined = docs.join(gone, (docs["doc_id"] == F.col(id_)) & (F.xxhash64(docs["text"].cast("string")) == F.col(hash_)), "left")
    parts = F.split(docs["text"], "\n", -1)
    # both lists are in order: one is walked along the other
    flags = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(i.alias("i")))
    left = F.array_except(F.transform(flags, lambda f: f["i"]), F.col(lines))
    text = F.when(F.col(lines).isNull(), docs["text"]).otherwise(F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n"))
    columns = [text.alias(c) if c == "text" else F.when(F.col(lines).isNull(), docs[c]).otherwise(F.length(text)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else docs[c] for c in docs.columns]
    filled = F.exists(left, lambda i: F.length(F.btrim(F.get(parts, i), F.lit(BLANKS))) > 0)
    return joined.where(F.col(lines).isNull() | filled).select(*columns)
