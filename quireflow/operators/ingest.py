"""Elements of manuals: normalized values, section paths, neighbours, reports; and chunks of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from quireflow.functions import text as T

# What parsers call their items, and the largest chunk.
TEXT_TYPES, IMAGE_TYPES, TABLE_TYPES = ("text", "page_footnote"), ("image", "chart", "equation"), ("table",)
SKIPPED_TYPES = ("header", "footer", "page_header", "page_footer", "page_number")
MAX_CHARS, LEAST_MAX_CHARS = 1200, 100


def element_type(source_type: Column) -> Column:
    """text, table, image, 'skipped' or, for anything else, 'unsupported'."""
    return (
        F.when(source_type.isin(*TEXT_TYPES), "text").when(source_type.isin(*TABLE_TYPES), "table").when(source_type.isin(*IMAGE_TYPES), "image")
        .when(source_type.isin(*SKIPPED_TYPES), "skipped").otherwise("unsupported")
    )


def page_no(page_idx: Column) -> Column:
    return F.when(page_idx >= 0, page_idx + 1)


def bbox(box: Column) -> Column:
    """Four finite ordered numbers, or null."""
    finite = F.forall(box, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when((F.size(box) == 4) & finite & (box[0] <= box[2]) & (box[1] <= box[3]), box)


def element_id(doc_id: Column, page: Column, kind: Column, index: Column, fingerprint: Column) -> Column:
    """doc:pNNNN:type:SSSSSS:hex16 over a canonical JSON text; a null page is 'unknown'."""
    token = F.when(page.isNull(), "unknown").otherwise(F.lpad(page.cast("string"), 4, "0"))
    return F.concat(doc_id, F.lit(":p"), token, F.lit(":"), kind, F.lit(":"), F.lpad(index.cast("string"), 6, "0"), F.lit(":"), F.left(F.sha2(fingerprint, 256), F.lit(16)))


#: Places of a document that one task orders; what runs on from block to block is carried by a summary of the blocks.
BLOCK = 4_096


def _order(place: str = "source_index", ident: str = "element_id") -> list[Column]:
    return [F.col(place), F.col(ident)]


def _blocked(df: DataFrame, place: str = "source_index", size: int | None = None) -> DataFrame:
    """``df`` with the block of each row, a range of places of its document."""
    return df.withColumn("_b", F.coalesce(F.floor(F.col(place) / (size or BLOCK)).cast("bigint"), F.lit(-1)))


def _in_block(*order: Column):
    return Window.partitionBy("doc_id", "_b").orderBy(*order)


_BLOCKS = ("doc_id", "_b")


def _over_blocks():
    return Window.partitionBy("doc_id").orderBy("_b")  # of summaries of blocks, not of rows


def _beside(df: DataFrame, values: dict[str, Column], order: list[Column], after: bool = False) -> DataFrame:
    """``df`` (blocked) with _before_x, and _after_x, of each value: that of the row before, or after, in its document."""
    at = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    ends = df.groupBy(*_BLOCKS).agg(F.max(F.struct(at, *[v.alias(n) for n, v in values.items()])).alias("last"), F.min(F.struct(at, *[v.alias(n) for n, v in values.items()])).alias("first"))
    sides = ends.select(*_BLOCKS, F.lag("last").over(_over_blocks()).alias("_l"), F.lead("first").over(_over_blocks()).alias("_f"))
    w = _in_block(*order)
    out = df.join(sides, list(_BLOCKS)).withColumn("_n", F.row_number().over(w))
    out = out.withColumn("_m", F.lead(F.lit(1)).over(w)) if after else out
    for n, v in values.items():
        out = out.withColumn(f"_before_{n}", F.when(F.col("_n") == 1, F.col(f"_l.{n}")).otherwise(F.lag(v).over(w)))
        if after:
            out = out.withColumn(f"_after_{n}", F.when(F.col("_m").isNull(), F.col(f"_f.{n}")).otherwise(F.lead(v).over(w)))
    return out.drop("_l", "_f", "_m")


def links(elements: DataFrame) -> DataFrame:
    """element_id with the ids before and after it in its document. Documents are ordered by blocks, so one manual with most
    of all elements is the work of many tasks."""
    df = _beside(_blocked(elements.select("doc_id", "element_id", "source_index")), {"id": F.col("element_id")}, _order(), after=True)
    return df.select("doc_id", "element_id", F.col("_before_id").alias("previous_id"), F.col("_after_id").alias("next_id"))


def nearest_text(elements: DataFrame) -> DataFrame:
    """Of each element, the nearest non-blank text before and after it within its run of one page; null if there is none.

    A run that goes on over the end of a block has the texts of the blocks it goes on in.
    """
    df = _blocked(elements.select("doc_id", "element_id", "source_index", "page_no", "element_type", "content")).withColumn("_p", F.coalesce("page_no", F.lit(-1)))
    w = _in_block(*_order())
    df = df.withColumn("_new", F.when(F.col("_p") == F.lag("_p").over(w), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    text = F.btrim("content", F.lit(" \t\r\n"))
    df = df.withColumn("_words", F.when((F.col("element_type") == "text") & (text != ""), text))
    run = Window.partitionBy(*_BLOCKS, "_run").orderBy(*_order())
    before = F.last("_words", ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("_words", ignorenulls=True).over(run.rowsBetween(1, Window.unboundedFollowing))
    found = df.select(*_BLOCKS, "_run", "element_id", before.alias("before"), after.alias("after"))
    at = F.struct("source_index", "element_id")
    said = F.when(F.col("_words").isNotNull(), F.struct(at.alias("at"), F.col("_words").alias("t")))
    pieces = df.groupBy(*_BLOCKS, "_run", "_p").agg(F.max(said)["t"].alias("_last"), F.min(said)["t"].alias("_first"))
    most = Window.partitionBy(*_BLOCKS)
    edge = pieces.withColumn("_most", F.max("_run").over(most)).where("_run = 1 OR _run = _most")
    order = Window.partitionBy("doc_id").orderBy("_b", "_run")  # two rows a block
    fresh = F.when((F.col("_p") == F.lag("_p").over(order)) & (F.col("_b") != F.lag("_b").over(order)), 0).otherwise(1)
    edge = edge.withColumn("_new", fresh).withColumn("_long", F.sum("_new").over(order))
    along = Window.partitionBy("doc_id", "_long").orderBy("_b", "_run")
    carried = edge.select(
        *_BLOCKS, "_run", F.last("_last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_cb"),
        F.first("_first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("_ca"),
    )
    return found.join(carried, [*_BLOCKS, "_run"], "left").select("element_id", F.coalesce("before", "_cb").alias("before"), F.coalesce("after", "_ca").alias("after"))


#: What parsers call the heading and the number of a page.
HEADER_TYPES, NUMBER_TYPES = ("header", "page_header"), ("page_number",)


def first_on_page(items: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """doc_id, page_no, text: the first non-blank text of those source types on each page, of items (doc_id, page_no,
    source_index, source_type, content)."""
    text = F.btrim("content")
    held = items.where(F.col("source_type").isin(*types) & F.col("page_no").isNotNull() & (text != ""))
    return held.groupBy("doc_id", "page_no").agg(F.min(F.struct("source_index", text.alias("t")))["t"].alias("text"))


def section_paths(elements: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """element_id and the titles over it, of any levels. A title of a level closes all deeper ones; levels left out leave no
    blank. ``headers`` (doc_id, page_no, text) are headings of pages: a page that has one starts anew under it, and a title of
    level 1 goes below it unless it says the same.

    A stack needs no fold: each event (a title, a page's heading) sets a slot and closes those after it, so a slot's text
    holds where it came no earlier than the last event of any slot before. Slots are those of the levels there are. The last
    events of the blocks before are carried in.
    """
    df = elements.select("doc_id", "element_id", "source_index", "page_no", "element_type", "content", "title_level")
    if headers is not None:
        df = df.join(headers.select("doc_id", "page_no", F.col("text").alias("_head")), ["doc_id", "page_no"], "left")
    df = _blocked(df)
    title = F.btrim("content")
    level = F.when((F.col("element_type") == "text") & (title != "") & (F.col("title_level") > 0), F.col("title_level"))
    df = df.withColumn("_at", F.struct("source_index", "element_id")).withColumn("_title", title).withColumn("_level", level)
    levels = sorted(r[0] for r in df.select("_level").where("_level IS NOT NULL").distinct().collect())  # as many as levels differ
    slots = sorted({0, 1, *(n - 1 for n in levels)}) if headers is not None else sorted({n - 1 for n in levels}) or [0]
    if headers is None:
        over, opens = F.lit(False), F.lit(False)
        df = df.withColumn("_head", F.lit(None).cast("string"))
    else:
        df = _beside(df, {"page": F.col("page_no")}, _order())
        opens = F.col("_head").isNotNull() & ~F.col("_before_page").eqNullSafe(F.col("page_no"))
        over = F.col("_head").isNotNull() & (F.lower("_head") != F.lower("_title"))
    df = df.withColumn("_opens", opens).withColumn("_under", over)
    top = F.coalesce(F.col("_level") == 1, F.lit(False))
    w = _in_block(*_order()).rowsBetween(Window.unboundedPreceding, 0)
    before = _over_blocks().rowsBetween(Window.unboundedPreceding, -1)

    def sets(p: int) -> Column:
        """What a row sets slot p to; a title beats the heading of the page it opens, which it stands under or replaces."""
        own = F.when(F.col("_level") == p + 1, F.when(~top | ~F.col("_under"), F.col("_title")))
        if p == 0:
            own = F.coalesce(F.when(top & F.col("_under"), F.col("_head")), own, F.when(F.col("_opens") & ~top, F.col("_head")))
        if p == 1:
            own = F.coalesce(F.when(top & F.col("_under"), F.col("_title")), own)
        return F.when(own.isNotNull(), F.struct(F.col("_at").alias("at"), own.alias("t")))

    def closes(p: int) -> Column:
        """Where a row closes the slots after p."""
        here = F.coalesce(F.col("_level") == p + 1, F.lit(False))
        return F.when(here | F.col("_opens") if p == 0 else here, F.col("_at"))

    makers = {f"_s{p}": sets(p) for p in slots} | {f"_c{p}": closes(p) for p in slots}
    sums = df.groupBy(*_BLOCKS).agg(*[F.max(c).alias(n) for n, c in makers.items()])
    carried = sums.select(*_BLOCKS, *[F.max(n).over(before).alias(f"_k{n}") for n in makers])
    df = df.join(carried, list(_BLOCKS))
    for n, c in makers.items():
        df = df.withColumn(n, F.coalesce(F.max(c).over(w), F.col(f"_k{n}")))
    parts, closed = [], None
    for p in slots:
        slot = F.col(f"_s{p}")
        fine = slot.isNotNull() if closed is None else slot.isNotNull() & F.coalesce(slot["at"] >= closed, F.lit(True))
        parts.append(F.when(fine & (slot["t"] != ""), slot["t"]))
        here = F.col(f"_c{p}")
        closed = here if closed is None else F.greatest(closed, here)
    return df.select("element_id", F.array_compact(F.array(*parts)).alias("path"))


def visual_context(path: Column, caption: Column, footnote: Column, recognized: Column, before: Column, after: Column, page: Column) -> Column:
    """What is said of an image or table: its section, captions, footnotes and recognized text (arrays), and the nearest texts;
    its page alone where nothing is."""
    line = lambda name, value, fine: F.when(F.coalesce(fine, F.lit(False)), F.concat(F.lit(f"{name}: "), value))
    joined = lambda c: F.array_join(c, " ")
    said = F.concat_ws(
        "\n", line("Section", F.array_join(path, " > "), F.size(path) > 0), line("Caption", joined(caption), F.size(caption) > 0), line("Footnote", joined(footnote), F.size(footnote) > 0),
        line("Recognized text", joined(recognized), F.size(recognized) > 0), line("Previous text", before, before != ""), line("Next text", after, after != ""),
    )
    alone = F.concat(F.lit("Visual element on PDF page "), F.coalesce(page.cast("string"), F.lit("unknown")), F.lit("."))
    return F.when(said != "", said).otherwise(alone)


def asset_path(native: Column, folder: Column) -> Column:
    """(path, code) of a parser's image path, taken from the folder (below the root) of the file that names it: missing,
    absolute and escaping ones have no path but a code; a good one has no code."""
    name = F.replace(native, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(F.concat_ws("/", F.nullif(folder, F.lit("")), name), "/"), lambda x: (x != "") & (x != "."))
    start = F.struct(F.array().cast("array<string>").alias("p"), F.lit(False).alias("out"))
    step = lambda s, x: F.struct(
        F.when(x != "..", F.concat(s["p"], F.array(x))).otherwise(F.slice(s["p"], 1, F.greatest(F.size(s["p"]) - 1, F.lit(0)))).alias("p"), (s["out"] | ((x == "..") & (F.size(s["p"]) == 0))).alias("out")
    )
    walked = F.aggregate(parts, start, step)
    code = F.when(F.coalesce(F.btrim(native), F.lit("")) == "", "missing_asset_path").when(name.rlike("^(/|[A-Za-z]:)"), "absolute_asset_path").when(walked["out"], "unsafe_asset_path")
    return F.struct(F.when(code.isNull(), F.array_join(walked["p"], "/")).alias("path"), code.alias("code"))


def resolved_assets(elements: DataFrame, files: DataFrame) -> DataFrame:
    """elements (element_id, native_path, folder) with path and code; a path that no file (path) has is asset_not_found."""
    df = elements.withColumn("_a", asset_path(F.col("native_path"), F.col("folder"))).select("element_id", F.col("_a.path").alias("path"), F.col("_a.code").alias("code"))
    held = files.select("path").distinct().withColumn("_there", F.lit(True))
    return df.join(held, "path", "left").select("element_id", "path", F.coalesce("code", F.when(F.col("_there").isNull(), "asset_not_found")).alias("code"))


def source_histogram(elements: DataFrame) -> DataFrame:
    """doc_id, source_type, kind, n: elements by what the parser called them."""
    return elements.groupBy("doc_id", "source_type", element_type(F.col("source_type")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def page_coverage(elements: DataFrame) -> DataFrame:
    """Pages by document: the last one of the source, those the source has items on, those elements are on, and blank ones."""
    source, last = F.countDistinct(F.when(F.col("page_idx") >= 0, F.col("page_idx"))), F.coalesce(F.max("page_idx") + 1, F.lit(0))
    kept = F.countDistinct("page_no")
    return elements.groupBy("doc_id").agg(last.alias("source_pages"), source.alias("pages_with_items"), kept.alias("pages_with_elements"), (last - source).alias("blank_pages"))


def anomalies(elements: DataFrame) -> DataFrame:
    """Elements' counts by document, and for all (a null document): by type, with their defects and pages."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return elements.rollup("doc_id").agg(
        n(F.col("element_type") == "text").alias("texts"), n(F.col("element_type") == "table").alias("tables"), n(F.col("element_type") == "image").alias("images"),
        n(F.col("page_no").isNull()).alias("missing_page"), n(F.btrim("content", F.lit(" \t\r\n")) == "").alias("blank_content"),
        n((F.col("element_type") != "text") & (F.coalesce("asset_path", F.lit("")) == "")).alias("missing_asset"),
        n(F.col("bbox").isNotNull() & bbox(F.col("bbox")).isNull()).alias("invalid_bbox"),
        n(element_type(F.col("source_type")) == "unsupported").alias("unsupported"), n(element_type(F.col("source_type")) == "skipped").alias("skipped"),
        n(F.col("asset_path").rlike(r"(^/|(^|/)\.\.(/|$))")).alias("invalid_asset"),
        F.countDistinct("page_no").alias("pages"), F.max("page_no").alias("last_page"),
    )


def chunks(elements: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """chunk_id, doc_id, chunk_type, page_no, page_nos, section_path, content, element_ids, place: the texts of documents in chunks.

    A warning, caution or note is a chunk of its own; a title ends a chunk and is dropped; others of one page, section
    and kind run together to ``max_chars``. One element above it stays whole. Runs that nothing can join are found by
    windows, and only inside such a run, no longer than a section's part of a page, sizes are folded.
    """
    if max_chars < LEAST_MAX_CHARS:
        raise ValueError("max_chars must be at least 100")
    df = elements.where("element_type = 'text'").withColumn("content", F.coalesce("content", F.lit(""))).withColumn("kind", T.chunk_kind(F.col("content")))
    df = df.withColumn("role", F.when(F.col("kind").isin("warning", "caution", "note"), "safety").when(F.col("title_level").isNotNull(), "title").otherwise("run"))
    key = F.struct(F.coalesce("page_no", F.lit(-1)).alias("page"), "section_path", "kind")
    df = _beside(_blocked(df.withColumn("key", key)), {"role": F.col("role"), "key": F.col("key")}, _order()).withColumnRenamed("_before_role", "before")
    same = (F.col("role") == "run") & (F.col("before") == "run") & (F.col("_before_key") == F.col("key"))
    starts = F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)
    df = df.withColumn("_c", F.sum(starts).over(_in_block(*_order())))
    # An island is named by the block it starts in and its number there; one that runs on has the name of the blocks before.
    named = F.when(F.col("_c") > 0, F.struct(F.col("_b").alias("b"), F.col("_c").alias("c")))
    last = df.groupBy(*_BLOCKS).agg(F.max(named).alias("_i"))
    running = last.select(*_BLOCKS, F.max("_i").over(_over_blocks().rowsBetween(Window.unboundedPreceding, -1)).alias("_running"))
    df = df.join(running, list(_BLOCKS)).withColumn("island", F.coalesce(named, F.col("_running"))).where("role <> 'title'")
    item = F.struct("source_index", "element_id", "content", F.length("content").alias("n"))
    islands = df.groupBy("doc_id", "island", "key", "role").agg(
        F.array_sort(F.collect_list(item)).alias("items"),
        # A run right after another, not after a safety text or a title, counts a joiner for its first element too.
        F.min_by(F.coalesce((F.col("before") == "run").cast("int"), F.lit(0)), F.struct("source_index", "element_id")).alias("joiner"),
    )
    start = F.struct(F.lit(0).alias("chars"), F.lit(-1).alias("no"), F.array().cast("array<int>").alias("labels"))

    def grow(state: Column, x: Column) -> Column:
        added = x["n"] + 1
        first, over = state["no"] < 0, state["chars"] + added > max_chars
        chars = F.when(first, x["n"] + F.col("joiner")).when(over, added).otherwise(state["chars"] + added)
        no = F.when(first | over, state["no"] + 1).otherwise(state["no"])
        return F.struct(chars.cast("int").alias("chars"), no.cast("int").alias("no"), F.concat(state["labels"], F.array(no.cast("int"))).alias("labels"))

    labels = F.aggregate("items", start, grow, lambda s: s["labels"])
    rows = islands.select("doc_id", "island", "key", "items", labels.alias("labels")).select("doc_id", "island", "key", F.explode(F.arrays_zip("items", "labels")).alias("z"))
    made = rows.groupBy("doc_id", "island", "key", F.col("z.labels").alias("part")).agg(F.array_sort(F.collect_list("z.items")).alias("items"))
    ids = F.transform("items", lambda i: i["element_id"])
    kind = F.col("key.kind")
    canonical = F.concat(F.lit('{"chunk_type":"'), kind, F.lit('","doc_id":"'), F.col("doc_id"), F.lit('","element_ids":'), F.to_json("element_ids"), F.lit("}"))
    out = made.select("doc_id", kind.alias("chunk_type"), F.when(F.col("key.page") >= 0, F.col("key.page")).alias("page_no"), F.array_compact(F.array(F.when(F.col("key.page") >= 0, F.col("key.page")))).alias("page_nos"), F.col("key.section_path").alias("section_path"), F.array_join(F.transform("items", lambda i: i["content"]), "\n").alias("content"), ids.alias("element_ids"), "key", F.col("items")[0]["source_index"].alias("place"))
    named = out.withColumn("chunk_id", F.concat("doc_id", F.lit(":chunk:"), "chunk_type", F.lit(":"), F.left(F.sha2(canonical, 256), F.lit(16))))
    return named.drop("key")


def chunk_links(made: DataFrame) -> DataFrame:
    df = _beside(_blocked(made, "place"), {"id": F.col("chunk_id")}, _order("place", "chunk_id"), after=True)
    return df.select(*made.columns, F.col("_before_id").alias("previous_chunk_id"), F.col("_after_id").alias("next_chunk_id"))


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key and code of each rule a row breaks; a rule that is null is broken."""
    codes = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules.items()]))
    return df.select(F.col(key).alias("record_id"), F.explode(codes).alias("code"))


#: Layouts of tables, first fit: name, what shows it, and replacements that leave a row a line and a tab between cells.
_TAGS = [(r"(?i)</?[a-z][^>\n]*>", ""), ("&nbsp;", " ")]
LAYOUTS = [
    ("html", r"(?i)<t[rdh][ >]", [(r"[\r\n]+", " "), (r"(?i)<tr[^>]*>", "\n"), (r"(?i)<t[dh][^>]*>", "\t"), *_TAGS, (r"\n\t", "\n")]),
    ("latex", r"\\begin\{tabular", [(r"\\begin\{tabular[^\n]*|\\end\{tabular\*?\}|\\hline", ""), (r" *\\+ *\n", "\n"), (r" & ", "\t"), (r"~", " ")]),
    ("wiki", r"^\s*\{\|", [(r"(?m)^(?:\{\||\|\}|\|-|\|\+).*$", ""), (r"(?m)^[|!] *", ""), (r" *(?:\|\||!!) *", "\t")]),
    ("quoted", r"^\s*\"", [(r'(?m)^"|"$', ""), (r'" *, *"', "\t")]),
    ("piped", r"^\s*\|", [(r"(?m)^\|[ :|-]+\|? *$", ""), (r"(?m)^\| *| *\| *$", ""), (r" *\| *", "\t"), *_TAGS]),
    ("starred", r"\*; ", [(r"\*; +", "\n"), (r"\*\. +", "\n"), (r" +(\d)", "\t\\1")]),
    ("barred", r" \| ", [(r" +\| +", "\t"), *_TAGS]),
    ("tabbed", r"\t", _TAGS),
    ("broken", r"(?i)<br ?/?>", [(r"(?i)<br ?/?>", "\n"), *_TAGS]),
    ("aligned", r"\S {2,}\S", [(r" {2,}", "\t")]),
]
#: A cell that names itself.
NAMED_CELL = r"^([^:\t]{1,60}): +(\S.*)$"


def table_layout(content: Column) -> Column:
    """The layout of a table's text; 'lines' for one that shows none, 'blank' for null or blank text."""
    out = F.when(F.btrim(F.coalesce(content, F.lit("")), F.lit(" \t\r\n")) == "", "blank")
    for name, test, _ in LAYOUTS:
        out = out.when(content.rlike(test), name)
    return out.otherwise("lines")


def table_lines(content: Column, layout: Column) -> Column:
    """The non-blank lines of a table as arrays of trimmed cells."""
    laid = content
    for name, _, steps in LAYOUTS:
        done = content
        for pattern, by in steps:
            done = F.regexp_replace(done, pattern, by.replace("\\1", "$1"))
        laid = F.when(layout == name, done).otherwise(laid)
    lines = F.filter(F.split(F.coalesce(laid, F.lit("")), "\n"), lambda s: F.btrim(s, F.lit(" \t\r")) != "")
    return F.transform(lines, lambda s: F.transform(F.split(F.btrim(s, F.lit("\r")), "\t"), lambda c: F.btrim(c)))


def table_cells(tables: DataFrame) -> DataFrame:
    """Tables (content, ...) with layout, place (from 1) and cells (header, value) of every row.

    The first line names the cells where it has two or more and none holds a digit, and is no row then; else cells that
    name themselves (``name: value``) do, and others are c1, c2, ... A line of fewer cells has nulls for the rest, one of
    more has further cells c3, ...; no line is left out. A blank table has no rows.
    """
    df = tables.withColumn("layout", table_layout(F.col("content"))).withColumn("_lines", table_lines(F.col("content"), F.col("layout")))
    first = F.col("_lines")[0]
    headed = (F.size("_lines") > 1) & (F.size(first) >= 2) & ~F.exists(first, lambda c: c.rlike("[0-9]"))
    df = df.withColumn("_heads", F.when(headed, first).otherwise(F.array().cast("array<string>"))).withColumn("_rows", F.when(headed, F.slice("_lines", 2, F.size("_lines"))).otherwise(F.col("_lines")))
    rows = df.select(*tables.columns, "layout", "_heads", F.posexplode("_rows").alias("_at", "_values")).withColumn("place", F.col("_at") + 1)

    def cell(i: Column) -> Column:
        head, value = F.get("_heads", i), F.get("_values", i)
        named = head.isNull() & value.rlike(NAMED_CELL)
        header = F.when(named, F.regexp_extract(value, NAMED_CELL, 1)).otherwise(F.coalesce(head, F.concat(F.lit("c"), (i + 1).cast("string"))))
        return F.struct(header.alias("header"), F.when(named, F.regexp_extract(value, NAMED_CELL, 2)).otherwise(value).alias("value"))

    n = F.greatest(F.size("_heads"), F.size("_values"))
    return rows.withColumn("cells", F.transform(F.sequence(F.lit(0), n - 1), cell)).drop("_heads", "_values", "_at")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
