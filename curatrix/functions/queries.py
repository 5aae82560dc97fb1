"""What a task asks for, and the search queries made of it. [Q1 - Q4]"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curatrix import constants as K
from curatrix.functions.text import clean_text, let, strip, words


def extract_signals(task: Column, max_concepts: int | None = None) -> Column:
    """[Q1] libraries, frameworks, language, keywords and concepts of a task; of these the first
    ``max_concepts`` where a number is asked for."""
    trimmed = F.transform(words(task), lambda w: F.lower(F.btrim(w, F.lit(K.SIGNAL_TRIM))))
    keywords = F.array_sort(F.array_distinct(F.filter(trimmed, lambda w: F.length(w) > 2)))
    libraries = F.array_intersect(keywords, F.array(*[F.lit(x) for x in K.KNOWN_LIBRARIES]))
    concepts = F.array_except(keywords, libraries)
    if max_concepts is not None:
        concepts = F.slice(concepts, 1, max_concepts)
    return F.struct(
        libraries.alias("libraries"),
        libraries.alias("frameworks"),
        F.array(F.lit("python")).alias("language"),
        keywords.alias("keywords"),
        concepts.alias("concepts"),
    )


def _joined(*parts: Column) -> Column:
    return F.array_join(F.concat(*parts), " ")


def expand_queries(task: Column, signals: Column, limit: int = 6) -> Column:
    """[Q2] Task and core phrase, bare and with each suffix; first of equal queries wins."""
    core = _joined(F.slice(signals["libraries"], 1, 3), F.slice(signals["concepts"], 1, 4))
    drafts = [strip(task), core]
    for suffix in K.QUERY_SUFFIXES:
        drafts.append(F.concat(task, F.lit(" " + suffix)))
        drafts.append(F.when(core != "", F.concat(core, F.lit(" " + suffix))))
    queries = F.filter(F.array(*drafts), lambda q: q.isNotNull() & (clean_text(q) != ""))

    def firsts(forms: Column) -> Column:
        return F.filter(queries, lambda q, i: F.array_position(forms, forms[i]) == i + 1)

    forms = F.transform(queries, lambda q: clean_text(F.lower(q)))
    return F.slice(let(forms, firsts), 1, limit)


def github_repo_queries(task: Column, signals: Column) -> Column:
    """[Q3] The task, then up to three libraries and three concepts as one example query."""
    libraries = F.slice(signals["libraries"], 1, 3)
    concepts = F.slice(signals["concepts"], 1, 3)
    sample = _joined(libraries, concepts, F.array(F.lit("example"), F.lit("python")))
    some = F.size(libraries) + F.size(concepts) > 0
    return F.when(some, F.array(task, sample)).otherwise(F.array(task))


def github_code_queries(task: Column, signals: Column, languages: Column | None = None) -> Column:
    """[Q3] One or two code queries for each of at most three languages."""
    chosen = signals["language"]
    if languages is not None:
        chosen = F.when(F.size(languages) > 0, languages).otherwise(chosen)
    libraries = F.array_join(F.slice(signals["libraries"], 1, 2), " ")
    per_language = F.transform(
        F.slice(chosen, 1, 3),
        lambda g: F.array(
            F.concat(task, F.lit(" language:"), g),
            F.when(libraries != "", F.concat(libraries, F.lit(" example language:"), g)),
        ),
    )
    return F.filter(F.flatten(per_language), lambda q: q.isNotNull())


def answer_tags(signals: Column) -> Column:
    """[Q4] The first three libraries, else python."""
    libraries = F.slice(signals["libraries"], 1, 3)
    return F.when(F.size(libraries) > 0, libraries).otherwise(F.array(F.lit("python")))
