"""Benchmark decontamination on templates, in DataFrame functions only.

1. Texts become templates: numbers, names (capitalised words inside a sentence) and units after a number turn into typed
   placeholders; the rest is lower-cased and loses its punctuation. A question with other numbers and names keeps its template.
   A capitalised word that begins a sentence is a slot of an item if it is a name elsewhere in the item. Windows over it meet
   those of documents with all such beginnings as names; the check accepts any beginning there.
2. Windows of `WINDOW` template words of the benchmark meet all windows of the documents by hash. Windows of fewer than
   `LITERAL` literal words would meet everywhere by their templates; they meet by their own words instead. An item of fewer
   than WINDOW words is one window of its own length.
3. Every (document, item, shift) that meets is checked word by word. A shift counts if its slots agree: one name always
   stands for one name and back, one number or unit always for one. Shifts that agree with one another count together.
4. A document is contaminated by an item if consistent windows cover enough of the item's words, or a run of `RUN` of them.

So every item can start a search: a run of WINDOW equal template words is found if it has a window with LITERAL literal
words, or one with unchanged slots. All windows count in the check.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import Scratch

WINDOW, LITERAL, RUN = 8, 4, 13
NAME, NUMBER, UNIT, START = "\x01", "\x02", "\x03", "\x04"
# Units that may follow a number.
UNITS = ("percent dollars euros pounds cents kg g mg lb km m cm mm miles feet inches hours hour minutes minute seconds "
         "second days day weeks week months month years year liters litres ml degrees mph kmh watts volts").split()
BROADCAST_ROWS = 200_000


def annotated(text: Column, starts: bool = True) -> Column:
    """The text with marked slots, in lower case and without punctuation. Marks stand before the slot's value.

    With `starts`, capitalised words that begin a sentence or a quotation have a mark, too.
    """
    t = F.regexp_replace(text, f"[{NAME}{NUMBER}{UNIT}{START}]", " ")
    # Each pattern first reads one character that few places have; looking back from every character costs much more.
    t = F.regexp_replace(t, r" (?<=[\p{L}\p{N},;] )(\p{Lu}\p{Ll}+)", f" {NAME}$1")
    if starts:
        t = F.regexp_replace(t, r"(?=[^a-z \n])(?<!\S)([\p{Ps}\p{Pi}\"']*)(\p{Lu}\p{Ll}+)", f"$1{START}$2")
    t = F.regexp_replace(t, r"(?=\d)(?<![^\s(\[$€£])(\d\S*)", f"{NUMBER}$1")
    t = F.regexp_replace(t, rf"(\d )({'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])", f"$1{UNIT}$2")
    t = F.regexp_replace(F.lower(t), rf"(?=[^a-z0-9 ])[^\p{{L}}\p{{N}}\s{NAME}{NUMBER}{UNIT}{START}]+", "")
    return F.btrim(t, F.lit(" \t\n\x0b\f\r"))


def plain(marked: Column) -> Column:
    return F.translate(marked, NAME + NUMBER + UNIT + START, "")


def template(marked: Column) -> Column:
    return F.regexp_replace(marked, rf"([{NAME}{NUMBER}{UNIT}])\S*", "$1")


def split_words(text: Column) -> Column:
    return F.split(text, r"\s+")


def window_hashes(texts: DataFrame, widths: list[int], starts: bool) -> DataFrame:
    """Adds `windows`, one hash per word and width of the window that begins there (null over the end), width after width.

    Hashes are of the template words, or of the words without marks in windows of fewer than LITERAL literal words. With
    `starts` the same follows with sentence beginnings as names, null for windows without any.
    """
    # A stretch of words is one number: 60 bits of hash, and the count of its slots in the lowest four.
    # A number may stand inside a word, as in `x(5`; the word is literal and the number not part of its code.
    codes = F.transform("words", lambda w: F.when(F.ascii(w) > 3, F.xxhash64(F.substring_index(
        F.translate(w, START, "") if starts else w, NUMBER, 1)).bitwiseAND(F.lit(-16))).otherwise(F.ascii(w).cast("long") * 16 + 1))
    begun = F.lit(ord(NAME) * 16)  # the code of a name, but a literal word
    named = F.transform("words", lambda w, i: F.when(F.ascii(w) == 4, begun.cast("long")).otherwise(F.get("codes1", i)))

    def joined(a: Column, b: Column) -> Column:
        hashed = F.xxhash64(F.shiftright(a, 4), F.shiftright(b, 4)).bitwiseAND(F.lit(-16))
        return hashed.bitwiseOR(a.bitwiseAND(F.lit(15)) + b.bitwiseAND(F.lit(15)))

    def hashes(width: int, by: str) -> Column:
        def key(code: Column, i: Column) -> Column:
            own = F.xxhash64(plain(F.array_join(F.slice("words", i + 1, width), " ")))
            n_slots, h = code.bitwiseAND(F.lit(15)), F.shiftright(code, 4)
            h = F.when((n_slots == 0) | (n_slots <= width - LITERAL), h).when(code.isNotNull(), own)
            return F.when(code != F.get(f"codes{width}", i), h) if by == "named" else h
        return F.transform(f"{by}{width}", key)

    # A wide stretch is joined from two narrower ones, the right one of a power of two. Those are read at two places or more,
    # or the optimizer would put their expressions into the lambda and compute them anew per window. Readers explode
    # `windows` with the outer form, for which no filter on the expression is inferred and pushed below.
    kinds = {"codes": codes, "named": named} if starts else {"codes": codes}
    own_columns = texts.columns
    for by, code in kinds.items():
        texts, ready, todo = texts.withColumn(f"{by}1", code), {1}, sorted(widths, reverse=True)
        while todo:
            w = todo[-1]
            right = w // 2 if w & (w - 1) == 0 else w & -w
            missing = [x for x in (w - right, right) if w > 1 and x not in ready]
            if missing:
                todo += missing
                continue
            if todo.pop() not in ready:
                ready.add(w)
                texts = texts.withColumn(f"{by}{w}", F.transform(f"{by}{w - right}", lambda a, i: joined(a, F.get(f"{by}{right}", i + (w - right)))))
    return texts.select(*own_columns, F.concat(*[hashes(w, by) for by in kinds for w in widths]).alias("windows"))


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.6, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, covered, n_words, n_slots, changed) of every document and item that it holds.

    `covered` of the item's `n_words` template words lie in consistent windows, at least `coverage` of them or RUN of them in a
    row at one shift. Shifts count together, the one that covers most first, as long as the slots of all agree; n_slots counts
    different slots there and `changed` tells whether any has another value than in the item.

    Null texts and ids, on either side, take no part, nor do items without words. Rows that
    repeat a doc_id or an item_id give one result, the larger. Other columns are ignored; empty tables give no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(
        "doc_id IS NOT NULL AND text IS NOT NULL").withColumn("text_key", F.xxhash64("text"))
    items = (benchmark.select(F.col(item_col).cast("long").alias("item_id"), annotated(F.col(item_text_col)).alias("marked"))
             .where("item_id IS NOT NULL AND marked <> ''").distinct()
             .select("item_id", F.xxhash64("marked").alias("item_key"), split_words("marked").alias("item_marked"),
                     split_words(plain(F.col("marked"))).alias("item_plain"),
                     F.filter(split_words("marked"), lambda w: F.ascii(w) == 1).alias("names")))
    begin = F.transform("item_marked", lambda w: F.translate(w, START, NAME))
    opens = F.exists("item_marked", lambda w: (F.ascii(w) == 4) & F.array_contains("names", F.translate(w, START, NAME)))
    known = F.transform("item_marked", lambda w, i: F.when(F.array_contains("names", F.get("begin", i)), F.get("begin", i))
                        .otherwise(F.translate(w, START, "")))
    items = (items.withColumn("begin", begin).withColumn("opens", opens).withColumn("item_words", known)
             .withColumn("item_template", F.transform("item_words", lambda w: template(w))).drop("begin", "names"))
    items = scratch.write(items, "items")
    starts = not items.where("opens").isEmpty()

    width = F.least(F.size("item_words"), F.lit(WINDOW))
    unopened = F.transform("item_marked", lambda w: F.translate(w, START, ""))
    # At most WINDOW widths.
    widths = sorted(r[0] for r in items.select(width).distinct().collect()) or [WINDOW]
    asks = [window_hashes(items.where((width == w) & (F.col("opens") | F.lit(not more)))
                          .select("item_id", "item_key", (F.col("item_marked") if more else unopened).alias("words")), [w], more)
            .select("item_id", "item_key", F.size("words").alias("n"), F.lit(w).alias("w"), F.posexplode_outer("windows").alias("j", "h"))
            .where("h IS NOT NULL AND j % n <= n - w").selectExpr("h", "item_id", "item_key", "j % n AS j")
            for w in widths for more in ([False, True] if starts else [False])]
    wanted = scratch.write(reduce(DataFrame.unionByName, asks).distinct(), "wanted")
    few = wanted.count() <= BROADCAST_ROWS

    marked = rows.select("doc_id", "text_key", split_words(annotated(F.col("text"), starts)).alias("words"))
    held = window_hashes(marked, widths, starts).select("doc_id", "text_key", F.size("words").alias("n"), F.posexplode_outer("windows").alias("p", "h"))
    met = held.join(F.broadcast(wanted) if few else wanted, "h")
    shifts = scratch.write(met.select("doc_id", "text_key", "item_id", "item_key", (F.col("p") % F.col("n") - F.col("j")).alias("shift"))
                           .distinct(), "shifts")

    asked = shifts.select("doc_id", "text_key").distinct()
    texts = rows.join(asked, ["doc_id", "text_key"], "left_semi").select("doc_id", "text_key", annotated(F.col("text")).alias("marked"))
    words = scratch.write(texts.select("doc_id", "text_key", split_words(plain(F.col("marked"))).alias("words"),
                                       split_words(template(F.translate("marked", START, ""))).alias("template"),
                                       split_words(template(F.translate("marked", START, NAME))).alias("named"))
                          .dropDuplicates(["doc_id", "text_key"]), "words")
    # Of the document only the words beside the item go on, so a shift costs what the item holds, however long the text is.
    ahead = F.greatest(-F.col("shift"), F.lit(0))
    beside = [F.slice(c, F.greatest("shift", F.lit(0)) + 1, F.size("item_words") - ahead).alias(c) for c in ("words", "template", "named")]
    sides = (shifts.join(F.broadcast(items) if few else items, ["item_id", "item_key"]).join(words, ["doc_id", "text_key"])
             .select("doc_id", "text_key", "item_id", "item_key", ahead.alias("ahead"), "item_words", "item_plain", "item_template", *beside)
             .withColumn("same", _same()))
    checked = sides.select("doc_id", "text_key", "item_id", "item_key", F.size("item_words").alias("n_words"), _covered().alias("at"),
                           "words", "item_words", "item_plain", "item_template", "ahead")
    slots = F.transform(F.filter("at", lambda j: F.ascii(F.get("item_template", j)) <= 3),
                        lambda j: F.struct(F.get("item_words", j).alias("a"), F.get("words", j - F.col("ahead")).alias("b"),
                                           F.get("item_plain", j).alias("c")))
    checked = checked.select("doc_id", "text_key", "item_id", "item_key", "n_words", "at", slots.alias("slots"))
    # The shift that covers most comes first; each further one joins it if the slots of all that joined still agree. No filter
    # stands on a computed column: it would be pushed down with `same` inside its lambdas, computed anew for each word.
    consistent = F.when((F.size("at") > 0) & _agree(F.col("slots")), F.struct((-F.size("at")).alias("less"), "at", "slots"))
    shifts_of = checked.groupBy("doc_id", "text_key", "item_id", "item_key").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.collect_set(consistent)).alias("found")).where(F.size("found") > 0)

    def take(held: Column, one: Column) -> Column:
        both = F.array_union(held["slots"], one["slots"])
        return F.when(_agree(both), F.struct(F.array_union(held["at"], one["at"]).alias("at"), both.alias("slots"))).otherwise(held)

    first = F.get("found", F.lit(0))
    joint = F.aggregate(F.slice("found", 2, F.greatest(F.size("found") - 1, F.lit(1))),
                        F.struct(first["at"].alias("at"), F.array_distinct(first["slots"]).alias("slots")), take)
    # Word numbers in `at` ascend, so RUN of them in a row differ by RUN - 1 from first to last.
    run = F.exists("found", lambda f: F.exists(
        F.transform(f["at"], lambda j, k: F.coalesce(F.get(f["at"], k + RUN - 1) == j + RUN - 1, F.lit(False))), lambda x: x))
    together = (shifts_of.select("doc_id", "item_id", "n_words", joint.alias("joint"), run.alias("run"))
                .select("doc_id", "item_id", "n_words", F.size("joint.at").alias("covered"), F.size("joint.slots").alias("n_slots"),
                        F.exists("joint.slots", lambda s: s["c"] != s["b"]).alias("changed"), "run"))
    enough = (F.col("covered") >= F.ceil(F.col("n_words") * coverage)) | F.col("run")
    best = F.max(F.when(enough, F.struct("covered", "n_words", "n_slots", "changed"))).alias("best")
    return together.groupBy("doc_id", "item_id").agg(best).where("best IS NOT NULL").select(
        "doc_id", "item_id", "best.covered", "best.n_words", "best.n_slots", "best.changed")


def _same() -> Column:
    """Per word of the item whether the document has its template word there, a name for a name, or the very word."""
    def equal(t: Column, i: Column) -> Column:
        at = i - F.col("ahead")
        return ((F.get("template", at) == t) | (F.get("words", at) == F.get("item_plain", i))
                | ((t == NAME) & (F.get("named", at) == NAME)))
    return F.transform("item_template", lambda t, i: F.coalesce(equal(t, i), F.lit(False)))


def _covered() -> Column:
    """Word numbers of the item, ascending, that lie in windows equal on both sides."""
    width = F.least(F.size("same"), F.lit(WINDOW))
    starts = F.filter(F.sequence(F.lit(0), F.size("same") - width),
                      lambda i: ~F.array_contains(F.slice("same", i + 1, width), False))
    return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.sequence(i, i + width - 1))))


def _agree(slots: Column) -> Column:
    """Every value of the item always stands for one value, and every name of the document for one name."""
    return _single(slots, "a") & _single(F.filter(slots, lambda s: F.ascii(s["a"]) == 1), "b")


def _single(pairs: Column, side: str) -> Column:
    """Every value of one side always comes with one value of the other."""
    return F.size(F.array_distinct(pairs)) == F.size(F.array_distinct(F.transform(pairs, lambda s: s[side])))
