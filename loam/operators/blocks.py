"""Blocks to units: heading paths, sections, size-bounded units (corpus build, second half)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..settings import DEFAULTS, Settings

LEVELS = range(1, 7)
SENTENCE_END = r"[.!?:;。！？]\s*$"


def heading_paths(flat: DataFrame, key: str = "page_id") -> DataFrame:
    """Blocks without headings, each with ``heading_path`` and ``heading_level``.

    A heading of some level is open at a block if it comes after the last heading of
    every shallower level; a heading that repeats its parent's text adds nothing.  Per
    level this is one running maximum, so the page's headings are never gathered.
    """
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = F.greatest(F.lit(1), F.least(F.lit(6), F.col("level")))
    is_heading = F.col("block_type") == "heading"
    title = T.collapsed("text")
    last = flat
    for n in LEVELS:
        seen = F.when(is_heading & (level == n) & (title != ""), F.struct(F.col("pos").alias("p"), title.alias("h")))
        last = last.withColumn(f"_h{n}", F.max(seen).over(w))
    open_: list[Column] = []
    newest = F.lit(-1)
    for n in LEVELS:
        h = F.col(f"_h{n}")
        alive = h.isNotNull() & (h["p"] > newest)
        open_.append(F.when(alive, F.struct(h["h"].alias("h"), F.lit(n).alias("n"))))
        newest = F.greatest(newest, F.coalesce(h["p"], F.lit(-1)))
    path = F.filter(F.array(*open_), lambda x: x.isNotNull())

    def step(done: Column, x: Column) -> Column:
        return F.when((F.size(done) > 0) & (F.element_at(done, -1)["h"] == x["h"]), done).otherwise(
            F.concat(done, F.array(x))
        )

    folded = F.aggregate(path, F.array().cast("array<struct<h:string,n:int>>"), step)
    return (
        last.withColumn("_path", folded)
        .where(~is_heading)
        .select(
            *[c for c in flat.columns if c != "level"],
            F.transform("_path", lambda x: x["h"]).alias("heading_path"),
            F.when(F.size("_path") > 0, F.element_at("_path", -1)["n"]).otherwise(0).alias("heading_level"),
        )
    )


def is_navigation(text: Column | str, settings: Settings = DEFAULTS) -> Column:
    """Furniture: no line ends like a sentence, and few words in all or per line."""
    text = F.col(text) if isinstance(text, str) else text
    lines = F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: T.stripped(x) != "")
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda x: x != ""))
    few = (words < settings.navigation_min_words) | (words / F.size(lines) < settings.navigation_words_per_line)
    prose = F.exists(lines, lambda x: x.rlike(SENTENCE_END))
    return F.lit(settings.drop_navigation) & ((F.size(lines) <= 0) | (~prose & few))


def sections(blocks: DataFrame, key: str = "page_id") -> DataFrame:
    """Blocks with ``section``: a run of blocks with one heading path, numbered from 1."""
    w = Window.partitionBy(key).orderBy("pos")
    same = F.lag("heading_path").over(w).eqNullSafe(F.col("heading_path")) & F.lag("pos").over(w).isNotNull()
    return blocks.withColumn("section", F.sum((~same).cast("int")).over(w))


def _tokens(text: Column, kind: Column) -> Column:
    return T.token_estimate(text, kind)


def units(blocks: DataFrame, key: str = "page_id", settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Blocks with heading paths to kept units and rejects.

    A section that fits is one unit.  A larger one is filled block by block up to the
    token and byte ceilings; the last blocks of a unit are carried into the next while
    they fit the overlap, and the carry is dropped if the unit would not fit with it.  A
    block that alone exceeds the ceiling is a unit of its own, at its place.  Units under
    the floor are rejected.  A section is folded as one array with running sums, in the
    JVM; it holds no more than its page's text.
    """
    stripped = T.stripped("text")
    live = blocks.where(stripped != "").withColumn("_nav", is_navigation("text", settings))
    furniture = live.where("_nav").select(
        key, "text", "heading_path", F.lit("navigation_boilerplate").alias("reason"),
        _tokens(F.col("text"), F.col("block_type")).alias("tokens"),
    )
    block = F.struct(
        F.col("pos"),
        stripped.alias("text"),
        F.col("block_type").alias("kind"),
        _tokens(F.col("text"), F.col("block_type")).alias("tokens"),
        F.length(T.collapsed("text")).alias("chars"),
        F.octet_length(stripped).alias("bytes"),
    )
    grouped = (
        sections(live.where("NOT _nav"), key)
        .groupBy(key, "section")
        .agg(F.first("heading_path").alias("heading_path"), F.sort_array(F.collect_list(block)).alias("blocks"))
    )
    kind = "struct<pos:int,text:string,kind:string,tokens:int,chars:int,bytes:int>"
    table = F.create_map(*[F.lit(x) for pair in T.CHARS_PER_TOKEN.items() for x in pair])

    def fit(kind_: Column, chars: Column, bytes_: Column) -> Column:
        divisor = F.coalesce(F.try_element_at(table, kind_), F.lit(T.DEFAULT_CHARS_PER_TOKEN))
        return (F.floor(chars / divisor) <= settings.chunk_max_tokens) & (bytes_ <= settings.send_ceiling)

    def total(bs: Column, name: str, gap: int) -> Column:
        return F.aggregate(bs, F.lit(0), lambda s, b: s + b[name]) + gap * F.greatest(F.size(bs) - 1, F.lit(0))

    def fits(bs: Column) -> Column:
        # joined by a blank line: one space when collapsed, two bytes when sent
        return fit(bs[0]["kind"], total(bs, "chars", 1), total(bs, "bytes", 2))

    empty = F.array().cast(f"array<{kind}>")

    def tail(bs: Column) -> Column:
        def step(state: Column, b: Column) -> Column:
            more = ~state["full"] & (
                (F.size(state["kept"]) == 0) | (state["spent"] + b["tokens"] <= settings.chunk_overlap_tokens)
            )
            return F.struct(
                F.when(more, F.concat(F.array(b), state["kept"])).otherwise(state["kept"]).alias("kept"),
                F.when(more, state["spent"] + b["tokens"]).otherwise(state["spent"]).alias("spent"),
                (~more).alias("full"),
            )

        start = F.struct(empty.alias("kept"), F.lit(0).alias("spent"), F.lit(False).alias("full"))
        kept = F.aggregate(F.reverse(bs), start, step, lambda s: s["kept"])
        return F.when(F.lit(settings.chunk_overlap_tokens > 0), kept).otherwise(empty)

    def state_of(done: Column, now: Column, chars: Column, bytes_: Column) -> Column:
        return F.struct(done.alias("done"), now.alias("now"), chars.alias("chars"), bytes_.alias("bytes"))

    def fill(state: Column, b: Column) -> Column:
        # sums of the open unit run along, so that a block costs the same however many came before
        alone, now = F.array(b), state["now"]
        some = F.size(now) > 0
        chars = state["chars"] + b["chars"] + F.when(some, 1).otherwise(0)
        bytes_ = state["bytes"] + b["bytes"] + F.when(some, 2).otherwise(0)
        closed = F.when(some, F.concat(state["done"], F.array(now))).otherwise(state["done"])

        def split(t: Column) -> Column:
            carried = F.concat(t, alone)
            return F.when(
                fits(carried), state_of(closed, carried, total(carried, "chars", 1), total(carried, "bytes", 2))
            ).otherwise(state_of(closed, alone, b["chars"], b["bytes"]))

        return (
            F.when(~fit(b["kind"], b["chars"], b["bytes"]), state_of(F.concat(closed, F.array(alone)), empty, F.lit(0), F.lit(0)))
            .when(some & ~fit(F.get(now, 0)["kind"], chars, bytes_), T.let(tail(now), split))
            .otherwise(state_of(state["done"], F.concat(now, alone), chars, bytes_))
        )

    start = state_of(F.array().cast(f"array<array<{kind}>>"), empty, F.lit(0), F.lit(0))
    filled = F.aggregate(
        "blocks", start, fill,
        lambda s: F.when(F.size(s["now"]) > 0, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]),
    )
    cut = F.when(fits(F.col("blocks")), F.array("blocks")).otherwise(filled)
    text = F.array_join(F.transform("unit", lambda b: b["text"]), "\n\n")
    pieces = (
        grouped.select(key, "section", "heading_path", F.posexplode(cut).alias("seq", "unit"))
        .withColumn("text", text)
        .withColumn("tokens", T.token_estimate("text", F.col("unit")[0]["kind"]))
        .withColumn("bytes", F.octet_length("text"))
        .withColumn("oversized", ~fits(F.col("unit")))
    )
    small = F.col("tokens") < settings.chunk_floor_tokens
    rejects = furniture.unionByName(
        pieces.where(small).select(key, "text", "heading_path", F.lit("below_usefulness_floor").alias("reason"), "tokens")
    )
    order = Window.partitionBy(key).orderBy("section", "seq")
    own = F.transform("unit", lambda b: b["text"])
    near = lambda f: (f("heading_path").over(order) == F.col("heading_path")) & F.arrays_overlap(f("texts").over(order), "texts")
    repeated = F.aggregate(
        F.filter("unit", lambda b: F.array_contains("previous", b["text"])), F.lit(0), lambda s, b: s + b["tokens"]
    )
    kept = (
        pieces.where(~small | F.col("oversized"))
        .withColumn("texts", own)
        .withColumn("ordinal", F.row_number().over(order) - 1)
        .withColumn("continued_from_previous", F.coalesce(near(F.lag), F.lit(False)))
        .withColumn("continues_into_next", F.coalesce(near(F.lead), F.lit(False)))
        .withColumn("previous", F.lag("texts").over(order))
        .withColumn("overlap_tokens", F.when(F.col("previous").isNull(), 0).otherwise(repeated))
        .withColumn("block_types", F.array_sort(F.array_distinct(F.transform("unit", lambda b: b["kind"]))))
        .withColumn("text_fingerprint", T.unit_fingerprint("text"))
        .select(
            key, "ordinal", "section", "text", "heading_path", "block_types", "tokens", "bytes", "oversized",
            "continued_from_previous", "continues_into_next", "overlap_tokens", "text_fingerprint",
        )
    )
    return kept, rejects
