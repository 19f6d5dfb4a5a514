"""Requests, prompts, and the validation of raw model replies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T

LEVELS = ("easy", "medium", "hard")
SYSTEM = "You write multiple-choice questions from given passages and answer with a JSON array only."
LETTERS = ("A", "B", "C", "D")


def validate_requests(requests: DataFrame) -> DataFrame:
    """Defaults (5 questions, medium) and ``reject_reason`` (null if the request is fine)."""
    out = requests.withColumn("num_questions", F.coalesce("num_questions", F.lit(5))).withColumn("difficulty", F.coalesce("difficulty", F.lit("medium")))
    reason = (
        F.when(F.col("doc_id").isNull(), "missing doc_id")
        .when(F.col("topic").isNull(), "missing topic")
        .when(~F.col("num_questions").between(1, 20), "num_questions not in 1..20")
        .when(~F.col("difficulty").isin(*LEVELS), "unknown difficulty")
    )
    return out.withColumn("reject_reason", reason)


def known_documents(requests: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests whose document holds a chunk, the others)."""
    known = chunks.select("doc_id").distinct()
    return requests.join(known, "doc_id", "left_semi"), requests.join(known, "doc_id", "left_anti")


def build_prompts(requests: DataFrame, hits: DataFrame, key: str = "request_id") -> DataFrame:
    """request_id, prompt: the hits in rank order as numbered blocks inside a fixed frame. A request has at
    most k hits, so its blocks fit in a row."""
    blocks = F.array_sort(F.collect_list(F.struct("rank", F.coalesce("source", F.lit("Unknown Document")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))))
    one = lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] (Source: "), x["source"], F.lit(")\n"), x["text"])
    context = hits.groupBy(key).agg(F.array_join(F.transform(blocks, one), "\n\n").alias("context"))
    ask = F.concat(
        F.lit(f"{SYSTEM}\n\nPassages:\n"), F.col("context"), F.lit("\n\nTopic: "), F.col("topic"), F.lit("\nDifficulty: "), F.col("difficulty"),
        F.lit("\nNumber of questions: "), F.col("num_questions").cast("string"),
    )
    return requests.join(context, key).select(key, ask.alias("prompt"))


def json_slice(raw: Column) -> Column:
    """Without code fences, from the first bracket or brace to the last."""
    return F.regexp_extract(F.regexp_replace(T.strip(raw), r"(?i)```(?:json)?", ""), r"(?s)[\[{].*[\]}]", 0)


def extract_json(raw: Column) -> Column:
    """The JSON value in a reply as VARIANT; null is a parse error (also for NaN and duplicate keys)."""
    return F.coalesce(F.try_parse_json(F.nullif(json_slice(raw), F.lit(""))), F.try_parse_json(T.strip(raw)))


def _kind(v: Column, path: str) -> Column:
    """VARIANT type at a path: null for a missing key, VOID for a JSON null."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def validate_mcq(item: Column) -> Column:
    """The first failed check of one question, or null."""
    whole = F.schema_of_variant(item)
    string = lambda p: F.try_variant_get(item, p, "string")
    blank = lambda p: T.strip(string(p)) == ""
    options = F.try_variant_get(item, "$.options", "map<string,variant>")
    out = (
        F.when(~whole.startswith("OBJECT"), "not a dict")
        .when(_kind(item, "$.question").isNull(), "missing question")
        .when((_kind(item, "$.question") != "STRING") | blank("$.question"), "question not a non-blank string")
        .when(_kind(item, "$.options").isNull(), "missing options")
        .when(~_kind(item, "$.options").startswith("OBJECT"), "options not a dict")
        .when(F.array_sort(F.map_keys(options)) != F.array(*[F.lit(x) for x in LETTERS]), "option keys not A-D")
    )
    for x in LETTERS:
        out = out.when((_kind(item, f"$.options.{x}") != "STRING") | blank(f"$.options.{x}"), f"option {x} not a non-blank string")
    return (
        out.when(_kind(item, "$.correct").isNull(), "missing correct")
        .when((_kind(item, "$.correct") != "STRING") | ~string("$.correct").isin(*LETTERS), "correct not in A-D")
        .when(_kind(item, "$.explanation").isNull(), "missing explanation")
        .when(_kind(item, "$.explanation") != "STRING", "explanation not a string")
        .when(F.length(T.strip(string("$.explanation"))) < 10, "explanation too short")
    )


def validate_replies(responses: DataFrame) -> DataFrame:
    """``responses`` (request_id, attempt, raw_response) with ``items`` (array of VARIANT, null unless a
    list), n_items, ``error`` (null if valid) and ``error_index``. The first bad item rejects the list."""
    parsed = responses.withColumn("v", extract_json(F.col("raw_response")))
    parsed = parsed.withColumn("items", F.try_variant_get("v", "$", "array<variant>"))
    parsed = parsed.withColumn("errors", F.transform("items", validate_mcq))
    index = F.array_position(F.transform("errors", lambda e: e.isNotNull()), True) - 1
    parsed = parsed.withColumn("error_index", F.when(index >= 0, index).cast("int"))
    error = F.when(F.col("v").isNull(), "parse error").when(F.col("items").isNull(), "not a list").when(
        F.col("error_index").isNotNull(), F.get("errors", F.col("error_index"))
    )
    return parsed.withColumn("error", error).withColumn("n_items", F.size("items")).drop("v", "errors")


def select_attempt(validated: DataFrame, max_attempts: int = 3) -> DataFrame:
    """One row per request: attempt, status (``valid``, ``empty``, ``failed``), error, items. The first
    attempt that is valid counts; one that parses to an empty list ends the request; after
    ``max_attempts`` the last error stands."""
    tried = validated.where(F.col("attempt") <= max_attempts)
    state = F.when(F.col("error").isNull() & (F.col("n_items") > 0), "valid").when(F.col("error").isNull(), "empty").otherwise("failed")
    order = Window.partitionBy("request_id").orderBy((state == "failed").cast("int"), F.when(state == "failed", -F.col("attempt")).otherwise(F.col("attempt")))
    first = tried.withColumn("status", state).withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return first.select("request_id", "attempt", "status", "error", "error_index", "items")


def number_questions(selected: DataFrame) -> DataFrame:
    """One row per question of the valid requests: request_id, id (from 1), question, options, correct,
    explanation, source_chunks."""
    rows = selected.where("status = 'valid'").select("request_id", F.posexplode("items").alias("pos", "q"))
    get = lambda p, kind: F.try_variant_get("q", p, kind)
    return rows.select(
        "request_id", (F.col("pos") + 1).alias("id"), get("$.question", "string").alias("question"),
        get("$.options", "map<string,string>").alias("options"), get("$.correct", "string").alias("correct"),
        get("$.explanation", "string").alias("explanation"),
        F.coalesce(get("$.source_chunks", "array<string>"), F.array().cast("array<string>")).alias("source_chunks"),
    )


def attach_source_chunks(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Questions that cite nothing cite the pages of their request's chunks: ``source:p{page}``."""
    cite = F.concat(F.col("source"), F.lit(":p"), F.col("page_start").cast("string"))
    cites = hits.groupBy("request_id").agg(F.array_sort(F.collect_set(cite)).alias("cites"))
    joined = questions.join(cites, "request_id", "left")
    own = F.when(F.size("source_chunks") > 0, F.col("source_chunks")).otherwise(F.coalesce("cites", F.col("source_chunks")))
    return joined.withColumn("source_chunks", own).drop("cites")


def assemble_quiz(questions: DataFrame, requests: DataFrame) -> DataFrame:
    """One row per request: request_id, doc_id, topic, questions[] in order (a quiz has at most some dozens)."""
    one = F.struct("id", "question", "options", "correct", "explanation", "source_chunks")
    in_order = F.array_sort(F.collect_list(one), lambda a, b: a["id"] - b["id"])
    quiz = questions.groupBy("request_id").agg(in_order.alias("questions"))
    return quiz.join(requests.select("request_id", "doc_id", "topic"), "request_id").select("request_id", "doc_id", "topic", "questions")


def grounding_check(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """request_id, id, grounding: share of the distinct words of question and right answer that its
    request's context (request_id, context) holds."""
    answer = F.coalesce(F.try_element_at("options", F.col("correct")), F.lit(""))
    words = lambda c: F.array_distinct(T.tokens(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}\s]", ""))))
    joined = questions.join(contexts.select("request_id", "context"), "request_id", "left")
    own = words(F.concat_ws(" ", "question", answer))
    share = F.size(F.array_intersect(own, words(F.coalesce("context", F.lit(""))))) / F.greatest(F.size(own), F.lit(1))
    return joined.select("request_id", "id", F.round(share, 4).alias("grounding"))


def generate(prompts: DataFrame, loader: Callable[[], Callable[[str], str]], accept: Callable[[str], bool] | None = None, max_attempts: int = 3) -> DataFrame:
    """Replies of a caller's model: request_id, attempt, raw_response. ``loader`` runs once per task; with
    ``accept`` an accepted reply ends a request's attempts."""
    kind = prompts.schema["request_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loader()
        for batch in batches:
            rows = []
            for rid, prompt in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for attempt in range(1, max_attempts + 1):
                    reply = model(prompt)
                    rows.append((rid, attempt, reply))
                    if accept and accept(reply):
                        break
            ids, attempts, replies = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(attempts, pa.int32()), pa.array(replies, pa.string())], ["request_id", "attempt", "raw_response"])

    return prompts.select("request_id", "prompt").mapInArrow(run, f"request_id {kind}, attempt int, raw_response string")
