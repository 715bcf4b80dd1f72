"""Corpus tables -> files with ordered blocks.

Every collection becomes the same row shape, one row per file:

    project_id string, label string, ext string, problem string,
    blocks array<struct<block_no int, kind string, text string,
                        rows array<array<string>>, location string>>

A document is already one row of the input, so its blocks are built with
array functions inside that row: no shuffle, no window, no join. Only
collections whose files span several input rows (conversation turns) need
one grouping shuffle on the file key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import needs_nfkc, py_strip

BLOCK_TYPE = ("struct<block_no:int,kind:string,text:string,"
              "rows:array<array<string>>,location:string>")
TABLE_ROW_MARK = " | "


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as it is now."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _block(block_no, kind, text, rows, location) -> Column:
    return F.struct(
        block_no.cast("int").alias("block_no"),
        F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"),
        text.cast("string").alias("text"),
        rows.cast("array<array<string>>").alias("rows"),
        location.alias("location"),
    )


def number_blocks(blocks: Column) -> Column:
    """Dense reading-order numbers, from 1, after blanks are dropped."""
    return F.transform(blocks, lambda b, i: b.withField("block_no", (i + 1).cast("int")))


def _cells(line: Column) -> Column:
    return F.transform(F.split(line, "\\|"), lambda c: py_strip(c))


def spread(df: DataFrame) -> DataFrame:
    """Round-robin the rows when the scan yields fewer partitions than there
    are cores (small inputs stored as one row group). Large inputs already
    arrive in many splits and are left alone: no extra shuffle at scale."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores * 2)
    return df


def with_text_blocks(df: DataFrame, text: str, out: str = "blocks") -> DataFrame:
    """S6 for plain text: each non-blank line is a paragraph (stripped);
    adjacent lines containing ' | ' form one table, split on '|' and
    trimmed. Location is 'line <n>' of the block's first line.

    Block boundaries come from an array of start positions and each block
    is one slice of the line array: linear in the document's length. Each
    intermediate array is its own column (referenced more than once, so the
    optimizer keeps it materialised instead of re-evaluating it inside the
    lambdas).
    """
    df = df.withColumn("_lines", F.split(F.coalesce(F.col(text), F.lit("")), "\n"))
    df = df.withColumn("_is_row", F.transform("_lines", lambda l: l.contains(TABLE_ROW_MARK)))
    lines, is_row = F.col("_lines"), F.col("_is_row")
    n = F.size(lines)  # split always yields at least one element
    df = df.withColumn("_starts", F.filter(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: ~((i > 1) & F.element_at(is_row, i) & F.element_at(is_row, F.greatest(i - 1, F.lit(1))))))
    starts = F.col("_starts")
    n_starts = F.size(starts)

    def block(s, k):
        nxt = F.when(k + 2 <= n_starts, F.element_at(starts, F.least(k + 2, n_starts))).otherwise(n + 1)
        table = F.element_at(is_row, s)
        return F.struct(
            F.lit(0).alias("block_no"),
            F.when(table, "table").otherwise("paragraph").alias("kind"),
            F.when(table, F.lit(None)).otherwise(py_strip(F.element_at(lines, s))).cast("string").alias("text"),
            F.when(table, F.transform(F.slice(lines, s, nxt - s), _cells)).cast("array<array<string>>").alias("rows"),
            F.concat(F.lit("line "), s.cast("string")).alias("location"),
        )

    df = df.withColumn("_raw", F.transform(starts, block))
    kept = F.filter("_raw", lambda b: (b["kind"] == "table") | (b["text"] != ""))
    return df.withColumn(out, number_blocks(kept)).drop("_lines", "_is_row", "_starts", "_raw")


def documents_files(spark: SparkSession, sf_dir: str, project: str = "source", only: DataFrame | None = None) -> DataFrame:
    """documents -> one text file per row; the column ``project`` is its
    project. ``only`` (project_id, label) leaves the named files, before any block is built."""
    d = read_table(spark, sf_dir, "documents").select(
        F.col(project).alias("project_id"), "text",
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("label"))
    if only is not None:
        d = d.join(only, ["project_id", "label"], "left_semi")
    d = with_text_blocks(spread(d), "text")
    return d.select(
        "project_id",
        "label",
        F.lit(".txt").alias("ext"),
        F.when(F.col("text").isNull(), F.lit("Could not read this file: no content.")).alias("problem"),
        F.col("blocks"),
        needs_nfkc(F.col("text")).alias("nfkc"),
    )


CONVERSATIONS_PROJECT = "conversations"


def turn_blocks(c: DataFrame) -> DataFrame:
    """conv_id, turn, nfkc and tb, the blocks of one turn (not yet numbered)."""
    slide = F.concat(F.lit("Slide "), (F.col("turn") + 1).cast("string"))
    para_blocks = F.transform(
        F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda l: py_strip(l) != ""),
        lambda l: _block(F.lit(0), "paragraph", py_strip(l), F.lit(None), slide))
    notes_text = py_strip(F.coalesce(F.col("text"), F.lit("")))
    notes_blocks = F.when(notes_text != "", F.array(
        _block(F.lit(0), "paragraph", notes_text, F.lit(None),
               F.concat(slide, F.lit(" (notes)"))))).otherwise(F.array().cast(f"array<{BLOCK_TYPE}>"))
    return c.select(
        "conv_id", "turn", needs_nfkc(F.col("text")).alias("nfkc"),
        F.when(F.col("role") == "system", notes_blocks).otherwise(para_blocks).alias("tb"))


#: Turns of a deck that are numbered together.
TURN_PIECE = 1024


def deck_blocks(conversations: DataFrame) -> DataFrame:
    """S7 in long form: conv_id, block_no, kind, text, location of every block.

    Block numbers need the blocks before a turn, not the turns: a deck is cut
    into pieces of turn numbers, pieces are counted, and a turn's first number
    is its piece's offset plus the turns before it in the piece. So a deck
    with a third of all turns is spread over as many tasks as it has pieces."""
    turns = turn_blocks(conversations).withColumn("piece", F.floor(F.col("turn") / TURN_PIECE)).withColumn("n", F.size("tb"))
    # a row a piece, not a turn
    counts = turns.groupBy("conv_id", "piece").agg(F.sum("n").alias("n"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("conv_id", "piece", F.coalesce(F.sum("n").over(
        before.partitionBy("conv_id").orderBy("piece")), F.lit(0)).alias("first"))
    inside = turns.withColumn("at", F.coalesce(F.sum("n").over(before.partitionBy("conv_id", "piece").orderBy("turn")), F.lit(0)))
    blocks = inside.join(offsets, ["conv_id", "piece"]).select("conv_id", "first", "at", F.posexplode("tb").alias("i", "b"))
    return blocks.select("conv_id", (F.col("first") + F.col("at") + F.col("i") + 1).alias("block_no"), "b.kind", "b.text", "b.location")


def conversations_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7 re-aimed: a conversation is a deck, turn t is 'Slide t+1'.

    Each non-blank line of a turn is a paragraph (stripped). A system turn
    is that slide's speaker notes: one block at 'Slide n (notes)'. Turns
    live in separate input rows, so the deck is assembled by one grouping
    on conv_id; each deck is bounded by its own size.
    """
    turns = turn_blocks(read_table(spark, sf_dir, "conversations"))
    decks = (turns.groupBy("conv_id")
             .agg(F.array_sort(F.collect_list(F.struct("turn", "tb"))).alias("turns"),
                  F.bool_or("nfkc").alias("nfkc")))
    return decks.select(
        F.lit(CONVERSATIONS_PROJECT).alias("project_id"),
        F.concat(F.lit("conv_"), F.col("conv_id").cast("string"), F.lit(".pptx")).alias("label"),
        F.lit(".pptx").alias("ext"),
        F.lit(None).cast("string").alias("problem"),
        number_blocks(F.flatten(F.transform("turns", lambda t: t["tb"]))).alias("blocks"),
        F.col("nfkc"),
    )


# The HTML entities the page decoder understands, in the order
# they are replaced ('&amp;' last so '&amp;lt;' stays '&lt;').
HTML_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"),
                 ("&middot;", "·"), ("&nbsp;", "\u00a0"), ("&amp;", "&")]
HTML_DROP = "(?is)<head\\b.*?</head>|<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->"
HTML_BLOCK_TAG = "(?i)<(/?)(h[1-6]|p|ul|div|footer|article|nav|header|main|section|body|html)\\b[^>]*>"
HTML_OPENERS = ["h1", "h2", "h3", "h4", "h5", "h6", "p", "ul", "div", "footer"]
MARK_OPEN, MARK_TAG = "\u0001", "\u0002"


def html_text(fragment: Column) -> Column:
    s = F.regexp_replace(fragment, "<[^>]*>", "")
    for ent, ch in HTML_ENTITIES:
        s = F.replace(s, F.lit(ent), F.lit(ch))
    return s


def with_html_blocks(df: DataFrame, html: str, out: str = "blocks") -> DataFrame:
    """S8 re-aimed at HTML: a block starts at each h1-h6, p, ul, div and
    footer and ends at the next block-level tag; tags are stripped and
    entities decoded; a ul is a one-row table with a cell per li. A
    non-blank h1-h6 sets the location '§<heading>' (itself included);
    before any heading it is 'body'. Blank paragraphs are kept, text is
    not stripped.
    """
    body = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), HTML_DROP, "")
    marked = F.regexp_replace(body, HTML_BLOCK_TAG, MARK_OPEN + "$1$2" + MARK_TAG)
    df = df.withColumn("_pieces", F.transform(
        F.slice(F.split(marked, MARK_OPEN), 2, 1 << 30),
        lambda p: F.struct(F.lower(F.substring_index(p, MARK_TAG, 1)).alias("tag"),
                           F.regexp_replace(p, "^[^" + MARK_TAG + "]*" + MARK_TAG, "").alias("body"))))

    def block(p):
        is_ul = p["tag"] == "ul"
        li = F.slice(F.split(p["body"], "(?i)<li\\b[^>]*>"), 2, 1 << 30)
        return F.struct(
            F.lit(0).alias("block_no"),
            F.when(is_ul, "table").otherwise("paragraph").alias("kind"),
            F.when(is_ul, F.lit(None)).otherwise(html_text(p["body"])).cast("string").alias("text"),
            F.when(is_ul, F.array(F.transform(li, lambda x: py_strip(html_text(x)))))
             .cast("array<array<string>>").alias("rows"),
            F.when(p["tag"].startswith("h"), F.lit("§")).alias("location"),
        )

    raw = F.transform(F.filter("_pieces", lambda p: p["tag"].isin(*HTML_OPENERS)), block)
    # a heading's location is '§' + its stripped text, when that is not blank
    df = df.withColumn("_raw", F.transform(raw, lambda b: b.withField("location", F.when(
        b["location"].isNotNull() & (py_strip(b["text"]) != ""),
        F.concat(b["location"], py_strip(b["text"]))))))
    df = with_carried_location(df, "_raw", "body", out)
    return df.withColumn(out, number_blocks(F.col(out))).drop("_pieces", "_raw")


def with_carried_location(df: DataFrame, raw: str, before_first: str, out: str) -> DataFrame:
    """Carry each non-null location forward over the blocks after it; blocks
    before the first one get ``before_first``. Linear: one slice per
    segment between consecutive headings."""
    arr = F.col(raw)
    n = F.size(arr)
    seq = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_heads", F.filter(
        seq, lambda i: F.element_at(arr, F.greatest(i, F.lit(1)))["location"].isNotNull()))
    heads = F.col("_heads")
    nh = F.size(heads)
    first = F.when(nh > 0, F.element_at(heads, 1)).otherwise(n + 1)
    pre = F.transform(F.slice(arr, 1, first - 1), lambda b: b.withField("location", F.lit(before_first)))

    def segment(h, k):
        nxt = F.when(k + 2 <= nh, F.element_at(heads, F.least(k + 2, F.greatest(nh, F.lit(1))))).otherwise(n + 1)
        loc = F.element_at(arr, h)["location"]
        return F.transform(F.slice(arr, h, nxt - h), lambda b: b.withField("location", loc))

    return df.withColumn(out, F.concat(pre, F.flatten(F.transform(heads, segment)))).drop("_heads")


def page_host(url: Column) -> Column:
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)


def pages_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages -> one HTML file per row; project = url host."""
    p = spread(read_table(spark, sf_dir, "pages"))
    p = with_html_blocks(p, "html")
    return p.select(
        page_host(F.col("url")).alias("project_id"),
        F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".html")).alias("label"),
        F.lit(".html").alias("ext"),
        F.when(F.col("html").isNull(), F.lit("Could not read this file: no content.")).alias("problem"),
        F.col("blocks"),
        needs_nfkc(F.col("html")).alias("nfkc"),
    )
