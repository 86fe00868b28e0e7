"""Batch enrichment with a pluggable model.

A model is a function ``list[prompt] -> list[(answer, prompt_tokens, completion_tokens)]``; a factory that
takes no argument builds it once per task. Nothing here opens a connection.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as V
from ..functions import text as X
from ..session import materialize, small_batches
from ..plans.actions import action_rows, compose
from ..schemas import ANSWER, FOLDER_ANSWER, USAGE
from ..sources import cache_store
from ..sources import ledger as usage_ledger
from ..sources.result_store import ResultStore
from . import budget, usage
from .budget import Budget
from .folder_match import match_folders
from .near_duplicates import first_per_group
from .ranking import rank_in_group, running_sum
from .scan_filters import gated_text

Model = Callable[[list[str]], list[tuple[str, int, int]]]

# What a bounded prompt holds of a text; prompts hold whole texts unless asked otherwise.
BOUNDED_PROMPT_CHARS = 2000

#: Prompts that a Python worker holds at a time.
PROMPTS_AT_ONCE = 500

#: Categories that one folder prompt tells of.
CATEGORIES_PER_PROMPT = 200

_ANSWER_FORM = (
    "Answer with one JSON object with the fields summary (one or two sentences), category, topics (two or three "
    "words), importance (high, medium or low), suggested_folder and confidence (0 to 1)."
)
_FOLDER_FORM = (
    "Answer with one JSON object with the fields directories (a list of folder paths, at most three levels deep) "
    "and reasoning."
)


def analysis_prompt(content: Column, criteria: str | None = None, max_chars: int | None = None) -> Column:
    """The prompt for one file: its name, its text and the wanted answer, with custom criteria if given."""
    body = X.truncated(content, max_chars, "... [truncated]")
    task = f"Describe this file by these criteria: {criteria}" if criteria else "Describe this file."
    return F.concat(F.lit(f"{task}\nFile: "), F.col("name"), F.lit("\nContent: "), body, F.lit(f"\n{_ANSWER_FORM}"))


def offline_model() -> Model:
    """A deterministic stand-in for a model: it judges the file by the name in the prompt."""
    def answer(prompt: str) -> tuple[str, int, int]:
        found = re.search(r"^File: (.*)$", prompt, re.MULTILINE)
        name = found.group(1) if found else ""
        category = next((c for c, words in V.CATEGORY_WORDS if any(w in name.lower() for w in words)), "General")
        text = json.dumps({"summary": f"About {name}", "category": category, "topics": [category.lower()]})
        return text, len(prompt.split()), len(text.split())
    return lambda prompts: [answer(p) for p in prompts]


def infer(rows: DataFrame, make_model: Callable[[], Model] = offline_model, batch_size: int = 5,
          prompt: str = "prompt", keep_prompt: bool = True) -> DataFrame:
    """Add ``answer``, ``prompt_tokens``, ``completion_tokens`` and ``error`` by calling the model in batches.

    A batch that fails is repeated row by row, so one bad prompt costs only its own answer. Prompts hold whole texts, so a Python worker gets
    few at a time, and without ``keep_prompt`` doesn't send them back.
    """
    small_batches(rows.sparkSession, PROMPTS_AT_ONCE)
    kept = [f for f in rows.schema.fields if keep_prompt or f.name != prompt]
    schema = T.StructType([
        *kept, T.StructField("answer", T.StringType()), T.StructField("prompt_tokens", T.LongType()),
        T.StructField("completion_tokens", T.LongType()), T.StructField("error", T.StringType())])

    def one(model: Model, text: str) -> tuple:
        try:
            return (*model([text])[0], None)
        except Exception as e:  # noqa: BLE001 - any failure of a user's model is that row's result
            return None, 0, 0, str(e)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for frame in frames:
            texts, results = frame[prompt].tolist(), []
            for at in range(0, len(texts), batch_size):
                batch = texts[at:at + batch_size]
                try:
                    answers = model(batch)
                    if len(answers) != len(batch):
                        raise ValueError("the model must give one answer per prompt")
                    results += [(*a, None) for a in answers]
                except Exception:  # noqa: BLE001
                    results += [one(model, t) for t in batch]
            columns = pd.DataFrame(results, columns=["answer", "prompt_tokens", "completion_tokens", "error"])
            yield pd.concat([frame[[f.name for f in kept]].reset_index(drop=True), columns], axis=1)

    return rows.mapInPandas(run, schema)


def parsed_answer(answer: Column, summary_chars: int | None = None) -> Column:
    """The fields of an answer, with ``form``: 'object', 'rescued' (JSON inside other text), 'text' or
    'not an object' (valid JSON of another kind, which counts as a failure)."""
    def is_object(v: Column) -> Column:
        return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))

    def fields(s: Column, form: Column) -> Column:
        return F.struct(
            F.coalesce(s["summary"], F.lit("")).alias("summary"),
            F.coalesce(s["category"], F.lit("General")).alias("category"),
            F.coalesce(s["topics"], F.array().cast("array<string>")).alias("topics"),
            F.coalesce(s["importance"], F.lit("medium")).alias("importance"),
            F.coalesce(s["suggested_folder"], F.lit("Documents")).alias("suggested_folder"),
            F.coalesce(s["confidence"], F.lit(0.7)).alias("confidence"),
            form.alias("form"))

    inner = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    whole, part = F.try_parse_json(answer), F.try_parse_json(inner)
    text = F.struct(
        (answer if summary_chars is None else F.left(answer, F.lit(summary_chars))).alias("summary"), F.lit("General").alias("category"),
        F.array().cast("array<string>").alias("topics"), F.lit("medium").alias("importance"),
        F.lit("Documents").alias("suggested_folder"), F.lit(0.5).alias("confidence"), F.lit("text").alias("form"))
    form = F.when(whole.isNotNull(), F.when(is_object(whole), "object").otherwise("not an object")).when(
        is_object(part), "rescued").otherwise("text")
    return X.let(form, lambda f: F.when(f == "text", text).otherwise(
        fields(F.from_json(F.when(f == "rescued", inner).otherwise(answer), ANSWER), f)))


def _first_match(name: Column, table: Sequence[tuple[str, list[str]]]) -> list[Column]:
    return [F.when(X.contains_any(name, words), F.lit(value)) for value, words in table]


def name_category() -> Column:
    """Category by words of the name, then by file type."""
    by_type = [F.when(F.col("file_type") == t, F.lit(c)) for t, c in V.CATEGORY_BY_TYPE.items()]
    return F.coalesce(*_first_match(F.lower("name"), V.CATEGORY_WORDS), *by_type, F.lit("General"))


def type_folder() -> Column:
    return F.coalesce(*[F.when(F.col("file_type") == t, F.lit(f)) for t, f in V.SUMMARY_FOLDER_BY_TYPE.items()], F.lit("Other"))


def metadata_summary() -> Column:
    """The summary of a file that no model has read."""
    kind = F.col("file_type")
    return F.struct(
        F.concat(kind, F.lit(" file: "), F.col("name")).alias("summary"), name_category().alias("category"),
        F.array(kind).alias("topics"), F.lit("medium").alias("importance"),
        type_folder().alias("suggested_folder"), F.lit(0.6).alias("confidence"))


SUMMARY_FIELDS = ["summary", "category", "topics", "importance", "suggested_folder", "confidence"]


def metadata_summaries(files: DataFrame) -> DataFrame:
    return files.select("seq", F.col("name").alias("file_name"), F.col("path").alias("file_path"), "file_type",
                        metadata_summary().alias("s")).select("seq", "file_name", "file_path", "file_type", "s.*")


@dataclass
class ModelRun:
    """What surrounds the model calls of a run: results kept from earlier runs, a cost limit, and a ledger of the calls.

    ``store`` is looked up before the model and takes the new results, under keys salted by ``salt`` (say, the model and the
    prompt's version) that expire after ``ttl_seconds``, if given. ``budget`` names provider and model and limits what is spent; what the ledger has already
    counts as spent. Every call goes to the ledger at ``ledger``, those for folders too.
    """

    at: Column
    store: ResultStore | None = None
    budget: Budget | None = None
    ledger: str | None = None
    salt: str | None = None
    ttl_seconds: int | None = None
    operation: str = "organization"

    def start(self, spark: SparkSession) -> None:
        """Refuses to start when the limit is already reached."""
        if self.budget is None:
            return
        if self.ledger is not None and not self.budget.spent_usd:
            try:
                self.budget.spent_usd = usage.totals(usage_ledger.read(spark, self.ledger)).first()["cost_usd"]
            except AnalysisException:  # no ledger yet
                self.budget.spent_usd = 0.0
        self.budget.start()

    def record(self, calls: DataFrame) -> None:
        """Append the ledger rows of calls that used tokens."""
        if self.ledger is not None:
            about = self.budget or Budget(0.0)
            rows = metered(calls, about.provider, about.model, self.at, self.operation)
            usage_ledger.append(usage.with_cost(rows, about.prices).select(*USAGE.fieldNames()), self.ledger)


def summarize(files: DataFrame, make_model: Callable[[], Model] = offline_model, content: str = "text",
              max_file_size_kb: int | None = None, batch_size: int = 5, criteria: str | None = None,
              max_chars: int | None = None, run: ModelRun | None = None) -> DataFrame:
    """Summaries by the model for text files with content, by metadata for all others and for failures.

    Carries ``prompt_tokens`` and ``completion_tokens`` (0 where no model was asked) and ``origin``: 'model', 'cache' or 'metadata'. The
    answers are written once, so that the model is called once per file, however often the summaries are used. Whole texts are
    read, of any size, unless ``max_file_size_kb`` or ``max_chars`` bounds them. With a ``run``, results kept by its store are used instead of
    the model (failures aren't kept), files beyond its budget get metadata summaries, and its ledger gets the calls.
    """
    files = files.withColumn("content", gated_text(content, max_file_size_kb))
    keep, zero = ["seq", "name", "path", "file_type"], F.lit(0).cast("bigint")
    named = [F.col("name").alias("file_name"), F.col("path").alias("file_path"), "file_type"]
    prompt = analysis_prompt(F.col("content"), criteria, max_chars).alias("prompt")
    texts = files.where(F.col("content") != "")
    stored = None
    if run is not None and run.store is not None:
        stored, texts = run.store.split(texts, run.at, cache_store.cache_key(run.salt))
        keep = [*keep, "key"]
    asked = texts.select(*keep, prompt)
    if run is not None and run.budget is not None:
        answered, paid = budget.answered_within(asked, run.budget, lambda rows: infer(rows, make_model, batch_size, keep_prompt=False))
    else:
        answered = paid = materialize(infer(asked, make_model, batch_size, keep_prompt=False), "answers")
    answered = answered.withColumn("parsed", parsed_answer(F.col("answer")))
    failed = F.col("answer").isNull() | (F.col("parsed.form") == "not an object")
    chosen = [F.when(failed, metadata_summary()[f]).otherwise(F.col(f"parsed.{f}")).alias(f) for f in SUMMARY_FIELDS]
    tokens = ["prompt_tokens", "completion_tokens"]
    by_model = answered.select("seq", *named, *chosen, *tokens, F.when(failed, "metadata").otherwise("model").alias("origin"))
    untold = files.where(F.col("content") == "")
    if run is not None and run.budget is not None:
        untold = untold.select(*files.columns).unionByName(texts.select(*files.columns).join(answered.select("seq"), "seq", "left_anti").select(*files.columns))
    by_metadata = metadata_summaries(untold).select("*", *(zero.alias(t) for t in tokens), F.lit("metadata").alias("origin"))
    summaries = by_model.unionByName(by_metadata)
    if run is None:
        return summaries
    if stored is not None:
        told = F.from_json("value", ANSWER)
        summaries = summaries.unionByName(stored.select("seq", *named, told.alias("told")).select(
            "seq", "file_name", "file_path", "file_type", *(F.col(f"told.{f}") for f in SUMMARY_FIELDS), *(zero.alias(t) for t in tokens),
            F.lit("cache").alias("origin")))
    summaries = materialize(summaries, "summaries")  # before the store goes on
    run.record(paid)
    if run.store is not None:
        new = answered.where(~failed).select("key", F.to_json(F.struct(*(F.col(f"parsed.{f}").alias(f) for f in SUMMARY_FIELDS))).alias("value"))
        run.store.upsert(cache_store.entries(new, F.col("key"), F.col("value"), run.at, run.ttl_seconds))
    return summaries


def metered(calls: DataFrame, provider: str, model: str, at: Column, operation: str = "organization") -> DataFrame:
    """Ledger rows, still without cost, for model calls (or the summaries they led to)."""
    return calls.where("prompt_tokens + completion_tokens > 0").select(
        at.alias("timestamp"), F.lit(provider).alias("provider"), F.lit(model).alias("model"),
        "prompt_tokens", "completion_tokens", F.lit(operation).alias("operation"))


def within_budget(rows: DataFrame, cost: Column, limit: float) -> DataFrame:
    """The rows, in ``seq`` order, before which less than ``limit`` has been spent."""
    spent = running_sum(rows.withColumn("_all", F.lit(0)).withColumn("_cost", cost), ["_all"], "seq", F.col("_cost"), "spent")
    return spent.where(F.col("spent") - F.col("_cost") < limit).drop("_all", "_cost")


def category_report(summaries: DataFrame) -> DataFrame:
    """Files per category, in order of first appearance."""
    return summaries.groupBy("category").agg(F.count("*").alias("n_files"), F.min("seq").alias("first_seq"))


def category_files(summaries: DataFrame, k: int = 5) -> DataFrame:
    """The first ``k`` files of each category with up to three topics."""
    shown = first_per_group(summaries, "category", k, "seq")
    return shown.select("category", "rank", "file_name", F.array_join(F.slice("topics", 1, 3), ", ").alias("topics"))


def folder_prompt(summaries: DataFrame, criteria: str | None = None, k: int = 5, per_page: int = CATEGORIES_PER_PROMPT) -> DataFrame:
    """``(page, prompt)``: prompts that ask for a folder structure, each for up to ``per_page`` categories in order of first
    appearance. Each category contributes ``k`` files and the number of the others, so a prompt is bounded by its categories."""
    lines = category_files(summaries, k).select("category", "rank", F.concat(
        F.lit("  - "), "file_name", F.lit(" (topics: "), "topics", F.lit(")\n")).alias("line"))
    lines = lines.groupBy("category").agg(F.sort_array(F.collect_list(F.struct("rank", "line"))).alias("lines"))
    more = F.when(F.col("n_files") > k, F.concat(
        F.lit("  ... and "), (F.col("n_files") - k).cast("string"), F.lit(" more files\n"))).otherwise(F.lit(""))
    block = F.concat(F.lit("\n"), "category", F.lit(":\n"), F.array_join(F.transform("lines", lambda x: x["line"]), ""), more)
    placed = rank_in_group(category_report(summaries).withColumn("_all", F.lit(0)), ["_all"], "first_seq", "place")
    paged = placed.withColumn("page", F.floor((F.col("place") - 1) / per_page))
    blocks = paged.join(lines, "category").select("page", F.struct("first_seq", block.alias("block")).alias("b"))
    listing = blocks.groupBy("page").agg(F.sort_array(F.collect_list("b")).alias("b"))
    task = f"Propose a folder structure by these criteria: {criteria}" if criteria else "Propose a folder structure."
    return listing.select("page", F.concat(
        F.lit(f"{task}\nFiles:"), F.array_join(F.transform("b", lambda x: x["block"]), ""), F.lit(f"\n{_FOLDER_FORM}")).alias("prompt"))


def fallback_folders(summaries: DataFrame) -> DataFrame:
    """Folders by category when no model proposes any: ``(first_seq, pos, folder)`` in order."""
    chain = F
    for category, folders in V.CATEGORY_DIRECTORIES.items():
        chain = chain.when(F.lower("category") == category, F.array(*[F.lit(f) for f in folders]))
    folders = chain.otherwise(F.array(F.concat(F.lit("Documents/"), "category")))
    return category_report(summaries).select("first_seq", F.posexplode(folders).alias("pos", "folder"))


def numbered_folders(folders: DataFrame) -> DataFrame:
    """``(pos, folder)`` of ordered ``(folder)`` rows, written so that the numbers stay."""
    return materialize(folders.select(F.monotonically_increasing_id().alias("pos"), "folder"), "folders")


def propose_folders(summaries: DataFrame, make_model: Callable[[], Model] | None = None, criteria: str | None = None,
                    run: ModelRun | None = None) -> DataFrame:
    """``(pos, folder)`` from a model call over each page of the folder prompt, each folder once, or the fallback without a (usable) answer."""
    if make_model is not None:
        asked = materialize(infer(folder_prompt(summaries, criteria), make_model, 1), "folders")
        if run is not None:
            run.record(asked)
        answer = F.try_parse_json("answer")
        usable = asked.where(F.schema_of_variant(answer).startswith("OBJECT")).select(
            "page", F.from_json("answer", FOLDER_ANSWER)["directories"].alias("d"))
        if not usable.isEmpty():
            listed = usable.select("page", F.posexplode("d").alias("at", "folder"))
            return numbered_folders(listed.groupBy("folder").agg(F.min(F.struct("page", "at")).alias("first")).orderBy("first"))
    return numbered_folders(fallback_folders(summaries).orderBy("first_seq", "pos"))


def enrichment_plan(summaries: DataFrame, folders: DataFrame, target: str = "", reason_chars: int | None = None) -> DataFrame:
    """Create the proposed folders ``(pos, folder)`` and move each file to its best one; reasons tell the whole summary or its
    first ``reason_chars``."""
    prefix = f"{target}/" if target else ""
    told = F.col("summary") if reason_chars is None else F.concat(F.left("summary", F.lit(reason_chars)), F.lit("..."))
    moves = action_rows(
        match_folders(summaries, folders), "move", source=F.col("file_path"),
        destination=F.concat(F.lit(prefix), "folder", F.lit("/"), "file_name"),
        reason=F.concat(F.lit("LLM categorized as "), "category", F.lit(": "), told),
        confidence=F.col("confidence"))
    # before every file, in their own order
    dirs = action_rows(folders, "create_dir", seq=F.col("pos") - (1 << 62), source=F.lit(""), destination=F.concat(F.lit(prefix), "folder"),
                       reason=F.lit("LLM-suggested directory structure"))
    return compose(dirs, moves)


def preview(files: DataFrame, max_files: int = 10, make_model: Callable[[], Model] = offline_model, content: str = "text") -> DataFrame:
    """Categories and proposed folders for the first ``max_files`` files, without moving anything."""
    summaries = summarize(files.orderBy("seq").limit(max_files), make_model, content)
    listed = propose_folders(summaries).agg(F.sort_array(F.collect_list(F.struct("pos", "folder"))).alias("f"))  # of the files shown
    folders = F.array_join(F.transform("f", lambda x: x["folder"]), ", ").alias("folders")
    return category_report(summaries).crossJoin(listed.select(folders)).select("category", "n_files", "folders")
