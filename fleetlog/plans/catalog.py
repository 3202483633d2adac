"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each query reads the driver tables under ``sf_dir`` (or data Spark derives
from them) and runs one operator of the library over the whole input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stacks
from ..sources import fixtures

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def query(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------- call stacks

@query("call_spans")
def q_call_spans(spark, sf_dir):
    return stacks.call_spans(fixtures.logs(spark, sf_dir))


@query("call_depth")
def q_call_depth(spark, sf_dir):
    return stacks.depth_all_rows(fixtures.logs(spark, sf_dir)).select("node", "tid", "id", "message", "depth")


@query("call_mismatches")
def q_call_mismatches(spark, sf_dir):
    return stacks.call_mismatches(fixtures.logs(spark, sf_dir, mismatched=True))


def _hard(spark, sf_dir):
    """Logs whose clock steps back and whose ENDs log shorter names, with the
    recovered names."""
    from ..operators import recover
    return recover.recover_logs(fixtures.logs(spark, sf_dir, hard=True), fixtures.symbols(spark))


@query("call_spans_hard")
def q_call_spans_hard(spark, sf_dir):
    return stacks.call_spans(_hard(spark, sf_dir), "rec_function", "rec_path")


@query("call_mismatches_hard")
def q_call_mismatches_hard(spark, sf_dir):
    return stacks.call_mismatches(_hard(spark, sf_dir), "rec_function", "rec_path")


@query("function_time")
def q_function_time(spark, sf_dir):
    return stacks.function_time(fixtures.logs(spark, sf_dir))


# ------------------------------------------------------------------- ingest

def _parsed(spark, sf_dir):
    from ..sources import logtext
    return logtext.check_files(logtext.parse_records(logtext.scan_records(
        spark, fixtures.rendered_dir(spark, sf_dir))))


@query("scan_records")
def q_scan_records(spark, sf_dir):
    from ..sources import logtext
    return logtext.scan_records(spark, fixtures.rendered_dir(spark, sf_dir)).select("node", "text")


@query("parse_header")
def q_parse_header(spark, sf_dir):
    from ..sources import logtext
    return logtext.good_rows(_parsed(spark, sf_dir)).drop("id")


@query("quarantine")
def q_quarantine(spark, sf_dir):
    from ..sources import logtext
    return logtext.quarantine(_parsed(spark, sf_dir)).select("node", "reason", "text")


@query("arrival_order")
def q_arrival_order(spark, sf_dir):
    from ..operators.ordered import id_chunk, running_count
    from ..sources import logtext
    good = logtext.good_rows(_parsed(spark, sf_dir))
    return running_count(good, ["node"], ["id"], "seq", id_chunk()).select("node", "seq", "level", "tid", "puttime")


@query("scan_nodes")
def q_scan_nodes(spark, sf_dir):
    from ..sources import logtext
    return logtext.rows_per_node(logtext.good_rows(_parsed(spark, sf_dir)))


@query("max_message")
def q_max_message(spark, sf_dir):
    from ..sources import logtext
    return logtext.max_message(logtext.good_rows(_parsed(spark, sf_dir)))


def _stored(spark, sf_dir):
    from ..session import scratch_path
    from ..sources import store
    root = scratch_path(spark, "log-table")
    # the derived table comes out of joins, so its tasks mix all times
    store.write_logs(fixtures.derive_logs(spark, sf_dir), root, range_partition=True)
    return store.read_stored(spark, root)


@query("write_read_back")
def q_write_read_back(spark, sf_dir):
    return _stored(spark, sf_dir)


@query("layout_roundtrip")
def q_layout_roundtrip(spark, sf_dir):
    from ..operators import select
    st = _stored(spark, sf_dir)
    return select.time_range(st.where(F.col("tid") == 3), "2024-01-08 00:00:00", "2024-01-22 12:00:00")


@query("items_catalog")
def q_items_catalog(spark, sf_dir):
    return fixtures.items(spark, sf_dir)


@query("list_items")
def q_list_items(spark, sf_dir):
    from ..sources import store
    return store.list_items(fixtures.items(spark, sf_dir), "node-1", "tid")


@query("list_nodes")
def q_list_nodes(spark, sf_dir):
    from ..sources import store
    return store.list_nodes(fixtures.logs(spark, sf_dir))


@query("node_select")
def q_node_select(spark, sf_dir):
    from ..sources import store
    return store.node_select(fixtures.logs(spark, sf_dir), "node-2")


@query("load_symbols")
def q_load_symbols(spark, sf_dir):
    from ..sources import symbols
    d = symbols.render_ctags_from_parts(spark, sf_dir)
    return symbols.load_ctags(spark, d).select("name", "path", "line")


# ------------------------------------------------------------------ select

RANGE_NODE, RANGE_START, RANGE_END = "node-1", "2024-01-10 06:30:00.9", "2024-01-20 18:45:10.5"
PREDICATE = "level <> 'INFO' AND (tid IN (1, 5, 9) OR function LIKE 'Commit%')"
CLAUSE = "level = 'WARNING' ORDER BY puttime DESC, id LIMIT 100"
ANCHOR = ("node-2", 7, "ProcessOrderBatchFromDisk", "2024-01-15 12:00:00")


@query("time_range")
def q_time_range(spark, sf_dir):
    from ..operators import select
    lg = fixtures.logs(spark, sf_dir).where(F.col("node") == RANGE_NODE)
    return select.natural_order(select.time_range(lg, RANGE_START, RANGE_END))


@query("time_range_default")
def q_time_range_default(spark, sf_dir):
    from ..operators import select
    return select.time_range(fixtures.logs(spark, sf_dir).where(F.col("node") == "node-3"))


@query("where_expr")
def q_where_expr(spark, sf_dir):
    from ..operators import select
    return select.where_expr(fixtures.logs(spark, sf_dir), PREDICATE)


@query("where_order_limit")
def q_where_order_limit(spark, sf_dir):
    from ..operators import select
    return select.where_clause(fixtures.logs(spark, sf_dir), CLAUSE)


@query("task_entries")
def q_task_entries(spark, sf_dir):
    from ..operators import select
    return select.task_entries(fixtures.logs(spark, sf_dir), 3, "ProcessOrderBatchFromQueue")


@query("nearest_entry")
def q_nearest_entry(spark, sf_dir):
    from ..operators import select
    node, tid, task, at = ANCHOR
    return select.nearest_entry(fixtures.logs(spark, sf_dir), node, tid, task, at)


def probes_from_events(spark, sf_dir):
    """One probe per error event: 90 minutes after it, for the task its
    thread runs on even / odd users."""
    from ..session import read_table
    ev = read_table(spark, sf_dir, "events").where(F.col("event_type") == "error")
    return ev.select(
        F.col("event_id").alias("probe_id"),
        F.concat(F.lit("node-"), (F.col("user_id") % 5).cast("string")).alias("node"),
        (F.col("user_id") % 12).alias("tid"),
        F.when(F.col("user_id") % 2 == 0, F.lit("CommitBatch")).otherwise(F.lit("ProcessOrderBatchFromQueue")).alias("task"),
        (F.col("ts") + F.expr("INTERVAL 90 MINUTES")).alias("at"))


@query("nearest_entry_many")
def q_nearest_entry_many(spark, sf_dir):
    from ..operators import select
    return select.nearest_entries(fixtures.logs(spark, sf_dir), probes_from_events(spark, sf_dir))


@query("rows_from")
def q_rows_from(spark, sf_dir):
    from ..operators import select
    lg = fixtures.logs(spark, sf_dir)
    node, tid, task, at = ANCHOR
    a = select.nearest_entry(lg, node, tid, task, at).collect()[0]
    return select.natural_order(select.rows_from(lg, node, tid, a["id"]))


@query("fleet_range")
def q_fleet_range(spark, sf_dir):
    from ..operators import select
    return select.fleet_range(fixtures.logs(spark, sf_dir), "2024-01-05 00:00:00", "2024-01-05 06:00:00")


# ---------------------------------------------------------------- recovery

@query("recover_symbols")
def q_recover_symbols(spark, sf_dir):
    from ..operators import recover
    keys = fixtures.logs(spark, sf_dir).select("function", "fileline").distinct()
    return recover.resolve_keys(keys, fixtures.symbols(spark))


def cut_keys(logs):
    """Logged keys with the function cut to 1, 6 and 11 characters too."""
    base = logs.select("function", "fileline")
    cuts = [base.select(F.substring("function", 1, n).alias("function"), "fileline") for n in (1, 6, 11)]
    out = base
    for c in cuts:
        out = out.unionByName(c)
    return out.distinct()


@query("recover_ties")
def q_recover_ties(spark, sf_dir):
    from ..operators import recover
    return recover.resolve_keys(cut_keys(fixtures.logs(spark, sf_dir)), fixtures.symbols(spark))


@query("recover_parts")
def q_recover_parts(spark, sf_dir):
    """Cut names and paths of the part symbols, looked up in the symbol table
    loaded from their ctags listing."""
    from ..operators import recover
    from ..sources import symbols
    table = symbols.load_ctags(spark, symbols.render_ctags_from_parts(spark, sf_dir))
    keys = table.select(F.substring("name", 1, 7).alias("function"),
                        F.concat(F.substring("path", -14, 14), F.lit(":"), (F.col("line") + 3).cast("string"))
                        .alias("fileline")).distinct()
    return recover.resolve_keys(keys, table)


@query("recover_logs")
def q_recover_logs(spark, sf_dir):
    from ..operators import recover
    r = recover.recover_logs(fixtures.logs(spark, sf_dir), fixtures.symbols(spark))
    return r.select("node", "id", "rec_function", "rec_path", "rec_line")


@query("render_rows")
def q_render_rows(spark, sf_dir):
    from ..operators import recover, select
    lg = fixtures.logs(spark, sf_dir)
    return select.render_rows(lg, recover.recover_logs(lg, fixtures.symbols(spark)))


@query("list_functions")
def q_list_functions(spark, sf_dir):
    from ..operators import recover
    return recover.list_functions(fixtures.logs(spark, sf_dir), fixtures.symbols(spark))


# -------------------------------------------------------------------- text

def _docs(spark, sf_dir):
    from ..session import read_table, spread
    return spread(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))


def _doc_search(spark, sf_dir, pred_fn):
    from ..operators import search
    d = search.with_tokens(_docs(spark, sf_dir), "text")
    return d.where(pred_fn(search)).select("doc_id", "source")


@query("tokens_porter")
def q_tokens_porter(spark, sf_dir):
    from ..operators import search
    p = search.postings(_docs(spark, sf_dir), ["doc_id"], "text", "porter")
    return p.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("term").alias("token"))


@query("tokens_words")
def q_tokens_words(spark, sf_dir):
    from ..functions import text as tx
    return _docs(spark, sf_dir).select("doc_id", F.explode(tx.word_tokens("text")).alias("token")).distinct()


@query("tokens_sub")
def q_tokens_sub(spark, sf_dir):
    from ..operators import search
    p = search.postings(_docs(spark, sf_dir), ["doc_id"], "text", "words")
    return p.select("doc_id", F.col("term").alias("token"))


@query("path_tokens")
def q_path_tokens(spark, sf_dir):
    from ..functions import text as tx
    from ..session import read_table
    return read_table(spark, sf_dir, "pages").select("page_id", F.explode(tx.path_tokens("url")).alias("token"))


@query("postings")
def q_postings(spark, sf_dir):
    from ..operators import search
    return search.log_postings(fixtures.logs(spark, sf_dir))


@query("posting_lookup")
def q_posting_lookup(spark, sf_dir):
    """Stored document postings of every word of the benchmark passages."""
    from ..functions import text as tx
    from ..operators import search
    from ..session import read_table
    post = fixtures.document_index(spark, sf_dir, stem=False).frame.withColumnRenamed("word", "term")
    words = read_table(spark, sf_dir, "benchmark").select(F.explode(tx.porter_tokens("text")).alias("word"))
    return (search.lookup(post, words, ["doc_id"])
            .groupBy("term").agg(F.countDistinct("doc_id").alias("docs"), F.count(F.lit(1)).alias("occurrences")))


@query("search_term")
def q_search_term(spark, sf_dir):
    return _doc_search(spark, sf_dir, lambda s: s.term("license", text="text"))


@query("search_prefix")
def q_search_prefix(spark, sf_dir):
    return _doc_search(spark, sf_dir, lambda s: s.prefix("Licen", text="text"))


@query("search_and")
def q_search_and(spark, sf_dir):
    return _doc_search(spark, sf_dir, lambda s: s.all_terms(["mit", "license"], text="text"))


@query("search_or")
def q_search_or(spark, sf_dir):
    return _doc_search(spark, sf_dir, lambda s: s.term("stupid", text="text") | s.term("worthless", text="text"))


@query("search_not")
def q_search_not(spark, sf_dir):
    return _doc_search(spark, sf_dir, lambda s: s.term("license", text="text") & ~s.term("mit", text="text"))


@query("search_phrase")
def q_search_phrase(spark, sf_dir):
    return _doc_search(spark, sf_dir, lambda s: s.phrase(["thtionea", "from", "eainan"], text="text"))


@query("search_near")
def q_search_near(spark, sf_dir):
    return _doc_search(spark, sf_dir, lambda s: s.near("thtionea", "ertionnd", 3, text="text"))


@query("search_semi")
def q_search_semi(spark, sf_dir):
    """Labels of the documents holding a word, via the stored index."""
    from ..operators import search
    from ..session import read_table
    hits = fixtures.document_index(spark, sf_dir, stem=False).term("stupid")
    return search.semi(read_table(spark, sf_dir, "labels"), hits, ["doc_id"])


@query("search_porter")
def q_search_porter(spark, sf_dir):
    """Stemmed search: documents with a word stemming like 'licensing'."""
    return fixtures.document_index(spark, sf_dir, stem=True).term("licensing")


def _log_search(spark, sf_dir, ask):
    """Rows of one node whose message is hit, through the stored index."""
    from ..operators import search, select
    index = fixtures.log_index(spark, sf_dir).within(F.col("node") == RANGE_NODE)
    return select.natural_order(search.node_rows(fixtures.logs(spark, sf_dir), ask(index), RANGE_NODE))


@query("search_logs_term")
def q_search_logs_term(spark, sf_dir):
    return _log_search(spark, sf_dir, lambda i: i.term("purchases"))


@query("search_logs_prefix")
def q_search_logs_prefix(spark, sf_dir):
    return _log_search(spark, sf_dir, lambda i: i.prefix("sign"))


@query("search_logs_and")
def q_search_logs_and(spark, sf_dir):
    return _log_search(spark, sf_dir, lambda i: i.both(i.term("error"), i.term("users")))


@query("search_logs_or")
def q_search_logs_or(spark, sf_dir):
    return _log_search(spark, sf_dir, lambda i: i.either(i.term("signup"), i.term("purchase")))


@query("search_logs_not")
def q_search_logs_not(spark, sf_dir):
    return _log_search(spark, sf_dir, lambda i: i.but_not(i.term("user"), i.term("error")))


@query("search_logs_phrase")
def q_search_logs_phrase(spark, sf_dir):
    return _log_search(spark, sf_dir, lambda i: i.phrase(["error", "user"]))


@query("search_logs_match")
def q_search_logs_match(spark, sf_dir):
    """Eight queries over the index of the whole fleet, in one pass."""
    from ..operators.match import match, near, phrase
    error, user, view = phrase("errors"), phrase("user"), phrase("view")
    return match(fixtures.log_index(spark, sf_dir), {
        "term": phrase("purchases"),
        "prefix": phrase("sign*"),
        "phrase": phrase("error", "user"),
        "prefix phrase": phrase("user", "1*", "props"),
        "near": near("click", "props", k=1),
        "near chain": near(phrase("view", "user"), "props", "k", k=1),
        "brackets": (error | view) & (user - phrase("1*")),
        "not": user - (near("user", "k", k=2) | error | phrase("sign*")),
    })


@query("stem_vocabulary_porter")
def q_stem_vocabulary_porter(spark, sf_dir):
    from ..functions import porter
    from ..functions import text as tx
    words = _docs(spark, sf_dir).select(F.explode(tx.porter_tokens("text")).alias("word"))
    return porter.stem_vocabulary(words.where(tx.is_stemmable(F.col("word"))), "word")


@query("fuzzy_functions")
def q_fuzzy_functions(spark, sf_dir):
    """Part-name words against all words of the documents, edit distance <= 2."""
    from ..functions import text as tx
    from ..operators import fuzzy
    from ..session import read_table
    a = read_table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    b = _docs(spark, sf_dir).select(F.explode(tx.porter_tokens("text")).alias("target"))
    return fuzzy.fuzzy_match(a, b, 2)


# ------------------------------------------------------- more call stacks

@query("call_spans_lenient")
def q_call_spans_lenient(spark, sf_dir):
    from ..operators import lenient
    spans, _ = lenient.lenient_fold(fixtures.logs(spark, sf_dir, mismatched=True))
    return spans


@query("call_mismatches_lenient")
def q_call_mismatches_lenient(spark, sf_dir):
    from ..operators import lenient
    _, mism = lenient.lenient_fold(fixtures.logs(spark, sf_dir, mismatched=True))
    return mism


@query("callstack_one")
def q_callstack_one(spark, sf_dir):
    node, tid, task, at = ANCHOR
    return stacks.callstack(fixtures.logs(spark, sf_dir), node, tid, task, at,
                            depths=fixtures.depths(spark, sf_dir)).select(
        "node", "tid", "id", "message", "depth")


@query("call_messages")
def q_call_messages(spark, sf_dir):
    return stacks.call_messages(fixtures.logs(spark, sf_dir))


@query("render_callstack")
def q_render_callstack(spark, sf_dir):
    lg = fixtures.logs(spark, sf_dir)
    return stacks.render_tree(lg, fixtures.symbols(spark))


@query("render_callstack_one")
def q_render_callstack_one(spark, sf_dir):
    from ..operators import recover
    lg = fixtures.logs(spark, sf_dir)
    node, tid, task, at = ANCHOR
    return stacks.callstack_text(recover.recover_logs(lg, fixtures.symbols(spark)), node, tid, task, at)


@query("list_functions_raw")
def q_list_functions_raw(spark, sf_dir):
    from ..operators import recover
    return recover.list_functions(fixtures.logs(spark, sf_dir))


BAD_ANCHOR = ("node-2", 7, "CommitBatch", "2024-01-17 16:22:00")


@query("callstack_lenient")
def q_callstack_lenient(spark, sf_dir):
    """One task's stack on logs with unlike ENDs: they are kept as
    ``unmatched`` and do not pop, so the task may stay open to the end."""
    node, tid, task, at = BAD_ANCHOR
    return stacks.callstack(fixtures.logs(spark, sf_dir, mismatched=True), node, tid, task, at,
                            depths=fixtures.depths(spark, sf_dir, mismatched=True)).select(
        "node", "tid", "id", "message", "depth", "unmatched")


@query("render_callstack_lenient")
def q_render_callstack_lenient(spark, sf_dir):
    from ..operators import recover
    lg = fixtures.logs(spark, sf_dir, mismatched=True)
    node, tid, task, at = BAD_ANCHOR
    return stacks.callstack_text(recover.recover_logs(lg, fixtures.symbols(spark)), node, tid, task, at)
