"""Context blocks, prompts, conversation memory, citations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.functions.text import strip, white

HISTORY = 6

ANSWER_PROMPT = """Answer the question from the sources below and from nothing else.
Cite each statement as [Source n]. Say so if the sources hold no answer.

Sources:
{context}

Question:
{question}

Answer:"""

REWRITE_PROMPT = """Earlier turns:
{history}
Latest question:
{question}

Write the latest question so that it can be read alone. Keep its meaning, use earlier turns only where
they are needed, do not answer it, and return the question only."""


def _known(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("Unknown"))


def context_block(index: Column, document: Column, source: Column, section: Column, score: Column, text: Column) -> Column:
    """One source in the prompt's format; white space around the block is cut."""
    block = F.concat(F.format_string("SOURCE %d\n\nDocument: %s\nSource File: %s\nSection: %s\nRRF Score: %.6f\n\nContent:\n", index, _known(document), _known(source), _known(section), F.coalesce(score, F.lit(0.0))), F.coalesce(text, F.lit("")))
    return strip(block)


def contexts(hits: DataFrame) -> DataFrame:
    """query_id, n_sources, context: blocks of hits (query_id, rank, document, source, section, score, text) by rank."""
    block = context_block(F.col("rank"), F.col("document"), F.col("source"), F.col("section"), F.col("score"), F.col("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))), lambda x: x["block"]), "\n\n")
    return hits.groupBy("query_id").agg(F.count("*").alias("n_sources"), joined.alias("context"))


def exchanges(turns: DataFrame) -> DataFrame:
    """conv_id, turn, question, answer: each user turn with the assistant turn that follows it at once (null if none does)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    after = turns.select("conv_id", "turn", "role", F.col("text").alias("question"), F.lead("role").over(w).alias("next"), F.lead("text").over(w).alias("said"))
    return after.where("role = 'user'").select("conv_id", "turn", "question", F.when(F.col("next") == "assistant", F.col("said")).alias("answer"))


def memory(turns: DataFrame, last: int = HISTORY) -> DataFrame:
    """exchanges with history: up to last earlier answered exchanges, oldest first."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-last, -1)
    answered = F.when(F.col("answer").isNotNull(), F.struct("question", "answer"))
    return exchanges(turns).withColumn("history", F.collect_list(answered).over(w))


def rewrite_prompt(history: Column, question: Column) -> Column:
    """The rewriting prompt; null where there is no history, as then the question stands alone."""
    shown = F.array_join(F.transform(history, lambda x: F.concat(F.lit("User: "), x["question"], F.lit("\nAssistant: "), x["answer"], F.lit("\n"))), "")
    text = F.replace(F.replace(F.lit(REWRITE_PROMPT), F.lit("{history}"), shown), F.lit("{question}"), question)
    return F.when(F.size(history) > 0, text)


def answer_prompt(context: Column, question: Column) -> Column:
    return F.replace(F.replace(F.lit(ANSWER_PROMPT), F.lit("{context}"), context), F.lit("{question}"), question)


def citations(answer: Column) -> Column:
    """Numbers cited as [Source n]."""
    return F.transform(F.regexp_extract_all(answer, F.lit("\\[Source[ \u202f]+(\\d+)\\]"), F.lit(1)), lambda x: x.cast("int"))


def citation_accuracy(answer: Column, n_sources: Column) -> Column:
    """The share of citations within 1..n_sources; 0 without citations."""
    cited = citations(answer)
    good = F.size(F.filter(cited, lambda x: (x >= 1) & (x <= n_sources)))
    return F.when(F.size(cited) == 0, 0.0).otherwise(good / F.size(cited))


def source_lines(hits: DataFrame) -> DataFrame:
    """query_id, shown: a numbered line for each hit (query_id, rank, document, source, section), as answers list their sources."""
    line = F.format_string("[Source %d] %s (%s) - %s", F.col("rank"), _known(F.col("document")), _known(F.col("source")), _known(F.col("section")))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("shown"))


def extractive(context: Column, question: Column) -> Column:
    """A stand-in for a language model: the sentence of the context that holds most different words of the question, the first of equals; null without a common word."""
    terms = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    sentences = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(context, F.lit("")), white(r"([.!?])\s+"), "$1\x00"), "\x00"), strip), lambda s: s != "")
    scored = F.transform(sentences, lambda s, i: F.struct(F.size(F.array_intersect(terms(s), terms(question))).alias("n"), (-i).alias("place"), s.alias("text")))
    best = F.array_max(scored)
    return F.when(best["n"] > 0, best["text"])


def generated(prompts: DataFrame, provider: Callable[[], Callable[[str], Iterator[str] | str]], prompt: str = "prompt") -> DataFrame:
    """prompts with answer and failed: what a provider says, loaded once a task; parts of a stream are joined, and a failure marks its row only.

    Null prompts have no answer.
    """

    @F.arrow_udf("struct<answer:string,failed:string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        say = provider()
        for b in batches:
            out = []
            for text in b.to_pylist():
                try:
                    out.append({"answer": None if text is None else "".join(say(text)), "failed": None})
                except Exception as e:  # the provider's own faults, whatever they are, belong to the row
                    out.append({"answer": None, "failed": f"{type(e).__name__}: {e}"})
            yield pa.array(out, pa.struct([("answer", pa.string()), ("failed", pa.string())]))

    return prompts.withColumn("__said", run(F.col(prompt))).withColumn("answer", F.col("__said.answer")).withColumn("failed", F.col("__said.failed")).drop("__said")


def judged(reply: Column, metrics: list[str]) -> Column:
    """struct of a judge's scores: the JSON object in its reply, whatever stands around it; a score that is missing or no number is null, never 0."""
    inner = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    read = F.from_json(inner, ", ".join(f"`{m}` string" for m in metrics))
    return F.struct(*[F.try_to_number(read[m], F.lit("S999999.999999")).cast("double").alias(m) for m in metrics])
