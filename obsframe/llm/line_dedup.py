"""Lines that recur across documents, by a log-template tree of fixed depth.

Native: DataFrame functions only. A line goes down the tree by its number of
tokens and its leading DEPTH tokens, of which one may be the wildcard; tokens
that hold a digit always are. In each leaf that many lines reach, the documents
that hold a token at a place are counted. Tokens of few documents become
wildcards, and what is left of the line is its template. Templates in many
documents are boilerplate and go from all documents but the first, as do lines
that recur just as they are but for digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsframe.llm.common import remove, shared_path, store

DEPTH = 3
WILDCARD = "<*>"
#: Documents in which a template must occur to be dropped, and a token at its place to be part of one.
LEAST_DOCUMENTS = 10
#: Tokens that a template with learned wildcards must keep, in number and as a share.
LEAST_KEPT, KEPT_SHARE = 5, 0.7
#: Leaves that are broadcast at most; more are joined by a shuffle.
BROADCAST_LEAVES = 1_000_000
#: Distinct lines of a leaf that one task holds at most.
LEAF_LINES = 10_000


_SPACES = "[ \\t\\x0B\\f\\r]+"
_UNEVEN = "[\\t\\x0B\\f\\r]|  "
#: A whole token that holds a digit; it is tried at token starts only, so long tokens cost one pass.
_VARIABLE = "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"


def masked(line: Column) -> Column:
    """The line's tokens joined by single spaces, those that hold a digit as wildcards."""
    # most lines have single spaces already, and a look is cheaper than a replacement
    plain = F.trim(F.when(line.rlike(_UNEVEN), F.regexp_replace(line, _SPACES, " ")).otherwise(line))
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, _VARIABLE, WILDCARD)).otherwise(plain)


def leading(line: Column, depth: int = DEPTH) -> tuple[Column, Column]:
    """The number of a masked line's tokens, and an array of the first ones."""
    count = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    return count, F.split(F.substring_index(line, " ", depth), " ")


def leaves(count: Column, lead: Column, depth: int = DEPTH) -> Column:
    """Hashes of the leaves that a masked line reaches: its number of tokens and leading tokens as they are, and
    with each of them as the wildcard. None for lines too short for a template."""
    paths = [[F.lit(WILDCARD) if k == wild else F.get(lead, F.lit(k)) for k in range(depth)] for wild in range(-1, depth)]
    return F.when(count > max(LEAST_KEPT, depth - 1), F.array_distinct(F.array(*(F.xxhash64(count, *p) for p in paths)))).otherwise(F.array().cast("array<bigint>"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _without(text: Column, gone: Column) -> Column:
    """The text without its lines at the places `gone`, in one pass."""
    lines = _lines(text)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    # an array of one struct, so that the text is split once and not for each line
    bound = F.array(F.struct(lines.alias("lines"), kept.alias("kept")))
    return F.get(F.transform(bound, lambda b: F.array_join(F.transform(b["kept"], lambda at: F.get(b["lines"], at)), "\n")), F.lit(0))


def learned_templates(places: DataFrame, least_documents: int, folder: str) -> DataFrame:
    """(_t, _g): for masked lines (`_t` their hash) the hashes of templates with learned wildcards."""
    reached = places.select("_id", "_t", "_line", F.explode("_leaves").alias("_leaf"))
    popular = store(reached.groupBy("_leaf").agg(F.count("*").alias("_n")).where(F.col("_n") >= least_documents).select("_leaf"), "leaves", folder)
    # one row for each distinct line of a leaf, however many documents hold it
    if popular.count() <= BROADCAST_LEAVES:
        distinct = reached.join(F.broadcast(popular), "_leaf").groupBy("_leaf", "_t").agg(F.count_distinct("_id").alias("_n"), F.first("_line").alias("_line"))
    else:
        # numbers are joined by a shuffle, and then each line is sent once and not once a leaf
        pairs = store(reached.drop("_line").join(popular, "_leaf").groupBy("_leaf", "_t").agg(F.count_distinct("_id").alias("_n")), "pairs", folder)
        distinct = pairs.join(places.groupBy("_t").agg(F.first("_line").alias("_line")), "_t").select("_leaf", "_t", "_n", "_line")
    distinct = store(distinct, "leaf-lines", folder)
    large = store(distinct.groupBy("_leaf").count().where(F.col("count") > LEAF_LINES).select("_leaf"), "large-leaves", folder)
    # a leaf of few lines is sent to one task, which counts its tokens
    small = _tokens(distinct.join(F.broadcast(large), "_leaf", "left_anti").repartition("_leaf"))
    kept = small.withColumn("_s", F.sum("_n").over(Window.partitionBy("_leaf", "_token"))).where(F.col("_s") >= least_documents)
    lined = _templates(kept)
    if not large.isEmpty():
        # others are counted token by token; by a shuffle at any size, as known tokens grow with the lines
        tokens = _tokens(distinct.join(F.broadcast(large), "_leaf"))
        known = tokens.groupBy("_leaf", "_token").agg(F.sum("_n").alias("_s")).where(F.col("_s") >= least_documents).select("_leaf", "_token")
        lined = lined.union(_templates(tokens.join(known.hint("merge"), ["_leaf", "_token"])))
    return lined.distinct()


def _tokens(lines: DataFrame) -> DataFrame:
    """For each line of a leaf its tokens but wildcards, a hash of place and token each."""
    words = lines.select("_leaf", "_t", "_n", F.split("_line", " ").alias("_words"))
    places = words.select("_leaf", "_t", "_n", F.size("_words").alias("_size"), F.posexplode("_words").alias("_place", "_word")).where(F.col("_word") != WILDCARD)
    return places.select("_leaf", "_t", "_n", "_size", F.xxhash64("_place", "_word").alias("_token"))


def _templates(known: DataFrame) -> DataFrame:
    """(_t, _g) of the lines that keep enough known tokens: a template is its number of tokens and the known
    ones by place; all others are wildcards."""
    lined = known.groupBy("_leaf", "_t", "_size").agg(F.array_sort(F.collect_list("_token")).alias("_p"))
    good = (F.size("_p") >= LEAST_KEPT) & (F.size("_p") >= KEPT_SHARE * F.col("_size"))
    return lined.where(good).select("_t", F.xxhash64("_size", "_p").alias("_g"))


def _recurring(places: DataFrame, least_documents: int, folder: str) -> DataFrame:
    """(_id, _text, _gone): of each text with recurring lines the places of those that go."""
    learned = store(learned_templates(places, least_documents, folder), "templates", folder)
    often = lambda of, t: of.groupBy(t).agg(F.count_distinct("_id").alias("_n"), F.min("_id").alias("_first")).where(F.col("_n") >= least_documents).select(t, "_first")
    plain = often(places.select("_id", "_t"), "_t")
    varied = often(places.select("_id", "_t").join(learned, "_t"), "_g").join(learned, "_g").select("_t", "_first")
    # written on its own, so that Spark can split the large partitions of the join behind it
    common = store(plain.union(varied).distinct(), "common", folder)
    later = places.select("_id", "_text", "_at", "_t").join(common, "_t").where(~F.col("_id").eqNullSafe(F.col("_first")))
    return later.groupBy("_id", "_text").agg(F.collect_set("_at").alias("_gone"))


def drop_recurring_lines(df: DataFrame, least_documents: int = LEAST_DOCUMENTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`df` with the text's recurring lines left out and `n_lines`, `n_dropped` (long) added.

    A line goes if one of its templates (the line with digits masked, and those with
    learned wildcards) occurs under at least `least_documents` ids and this row's id
    isn't the smallest of them; so each template stays in one document. A learned
    template keeps LEAST_KEPT tokens and KEPT_SHARE of all. Lines end at \\n; those
    without tokens always stay; a document's own repeats of a line count once and go
    or stay together. Null texts stay null with 0 lines, empty ones have 1 line. Rows
    that repeat an id are one document in the counts and keep their rows. Null ids
    don't count; their lines go if common. Other columns stay (those named n_lines
    or n_dropped are replaced); an empty table gives an empty one.

    What is joined to the common templates are numbers, and Spark splits large
    partitions of that join; texts are shuffled once, by id.
    """
    df = df.drop("n_lines", "n_dropped")
    # the text is hashed before it is exploded, once and not for each line
    whole = df.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text"), _lines(F.col(text_col)).alias("_raw"))
    # lines without tokens go by a look at the line as it is: a condition on the masked line would mask it twice
    split = whole.select("_id", "_text", F.posexplode("_raw").alias("_at", "_raw")).where(F.col("_raw").rlike("[^ \\t\\x0B\\f\\r]"))
    split = split.select("_id", "_text", "_at", masked(F.col("_raw")).alias("_line"))
    # columns of their own: inside a condition they would be worked out once a use
    count, lead = leading(F.col("_line"))
    split = split.select("*", F.xxhash64("_line").alias("_t"), count.alias("_count"), lead.alias("_lead"))
    lines = split.select("_id", "_text", "_at", "_line", "_t", leaves(F.col("_count"), F.col("_lead")).alias("_leaves"))
    folder = shared_path(df.sparkSession, "line-dedup")
    try:
        gone = store(_recurring(store(lines, "lines", folder), least_documents, folder), "gone")
    finally:
        # before the texts are joined, so that they are never on disk beside their lines
        remove(df.sparkSession, folder)
    # columns by their table, as `df` may have any names
    text = df[text_col]
    # by a shuffle at any size, as the texts with recurring lines grow with the input
    rows = df.join(gone.hint("merge"), df[id_col].eqNullSafe(gone["_id"]) & (F.xxhash64(text) == gone["_text"]), "left")
    total = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    left = F.when(gone["_gone"].isNull(), text).otherwise(_without(text, gone["_gone"]))
    dropped = F.coalesce(F.size(gone["_gone"]), F.lit(0)).cast("long")
    return rows.select(*(left.alias(c) if c == text_col else df[c] for c in df.columns), total.alias("n_lines"), dropped.alias("n_dropped"))


#: DuckDB: what the line-dedup query returns; `{docs}` stands for the table.
SQL = """
    WITH lines AS (
        SELECT doc_id, generate_subscripts(l, 1) AS place, unnest(l) AS line
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM {docs})
    ), named AS (
        SELECT doc_id, place, line, list_transform(list_filter(regexp_split_to_array(line, '[ \\t\\x0B\\f\\r]+'), lambda t: t <> ''),
            lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS t FROM lines
    ), held AS (SELECT DISTINCT doc_id, t FROM named WHERE len(t) > 0
    ), distinct_lines AS (SELECT t, count(*) AS docs FROM held GROUP BY t
    ), paths AS (
        SELECT DISTINCT t, docs, len(t) AS n, unnest([[t[1], t[2], t[3]], ['<*>', t[2], t[3]], [t[1], '<*>', t[3]], [t[1], t[2], '<*>']]) AS leaf
        FROM distinct_lines WHERE len(t) > {kept}
    ), popular AS (
        SELECT * FROM paths JOIN (SELECT n, leaf FROM paths GROUP BY n, leaf HAVING sum(docs) >= {least}) USING (n, leaf)
    ), tokens AS (SELECT n, leaf, t, docs, generate_subscripts(t, 1) AS k, unnest(t) AS token FROM popular
    ), known AS (SELECT n, leaf, k, token FROM tokens GROUP BY ALL HAVING sum(docs) >= {least}
    ), spelled AS (
        SELECT n, leaf, t, list(CASE WHEN k.token IS NULL THEN '<*>' ELSE k.token END ORDER BY x.k) AS g
        FROM tokens x LEFT JOIN known k USING (n, leaf, k, token) GROUP BY n, leaf, t
    ), learned AS (
        SELECT DISTINCT t, g FROM (SELECT *, len(list_filter(g, lambda w: w <> '<*>')) AS kept FROM spelled) WHERE kept >= {kept} AND kept >= {share} * n
    ), common AS (
        SELECT t, first FROM (SELECT t, min(doc_id) AS first FROM held GROUP BY t HAVING count(*) >= {least})
        UNION SELECT t, first FROM learned JOIN (SELECT g, min(doc_id) AS first FROM held JOIN learned USING (t) GROUP BY g HAVING count(DISTINCT doc_id) >= {least}) USING (g)
    ), gone AS (SELECT DISTINCT n.doc_id, n.place FROM named n JOIN common c ON n.t = c.t AND n.doc_id <> c.first)
    SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
           md5(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_md5
    FROM (SELECT n.doc_id, n.place, n.line, g.place IS NOT NULL AS gone FROM named n LEFT JOIN gone g ON n.doc_id = g.doc_id AND n.place = g.place)
    GROUP BY doc_id
"""
