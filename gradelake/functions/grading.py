"""The rule-based grader and the bands of reports."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradelake.functions.text import or_default, parsed_options, strip


def rounded(x: Column) -> Column:
    """Nearest whole number, halves up."""
    return F.floor(x + F.lit(0.5)).cast("int")


@dataclass
class Grade:
    is_correct: Column
    score: Column
    coverage: Column
    matched: Column
    n_keywords: Column
    keywords: Column
    blank: Column
    is_option: Column


def grade(question_type: Column, correct: Column, options: Column, points: Column, answer: Column) -> Grade:
    """Grade one answer: blank, multiple choice by option or prefix, else by keyword coverage.

    Keywords are the first six words of more than four letters of the expected answer, counted
    if they occur anywhere in the answer. Coverage from 0.65 earns 60 % of the points, from
    0.85 all, less than 0.65 earns 20 %; it is correct from 0.70.
    """
    expected, given = F.lower(F.coalesce(correct, F.lit(""))), strip(F.lower(F.coalesce(answer, F.lit(""))))
    worth = or_default(points, 10).cast("int")
    blank = F.length(given) < 2
    is_option = F.exists(parsed_options(options), lambda o: strip(F.lower(o)) == given)
    same = strip(expected) == given
    loose = (given == expected) | F.contains(expected, F.left(given, F.lit(12))) | F.contains(given, F.left(expected, F.lit(12)))
    chosen = F.when(is_option, same).otherwise(loose)
    keywords = F.slice(F.filter(F.split(expected, r"\W+"), lambda w: F.length(w) > 4), 1, 6)
    n = F.size(keywords)
    matched = F.size(F.filter(keywords, lambda k: F.contains(given, k)))
    coverage = matched / F.greatest(n, F.lit(1))
    mcq = F.coalesce(question_type, F.lit("")) == "mcq"
    is_correct = F.when(blank, False).when(mcq, chosen).otherwise(coverage >= 0.7)
    by_words = F.when(coverage >= 0.85, worth).when(coverage >= 0.65, rounded(worth * 0.6)).otherwise(rounded(worth * 0.2))
    score = F.when(blank, 0).when(mcq, F.when(chosen, worth).otherwise(0)).otherwise(by_words)
    return Grade(is_correct, score.cast("int"), coverage, matched.cast("int"), n.cast("int"), keywords, blank, is_option)


# What the grader says, by outcome: (feedback, conceptual gap). {c120} is the first
# 120 characters of the cited chunk, {e..} of the expected and {a..} of the given answer.
BLANK = ('No substantive answer — the grounded chunk notes: "{c120}…". Gemma flags missing engagement with the cited source.', "Gap: Absence of retrieval — re-read the cited chunk and restate the core idea in one sentence focusing on WHY.")
OPTION_RIGHT = ('Correct — aligns with the grounded source: "{c110}…". You discriminated the diagnostic distractors.', "No gap. Stretch: write one sentence for why each distractor is wrong.")
OPTION_WRONG = ('Your choice "{a}" does not match the grounded expectation "{e}". The chunk states: "{c120}…".', "Misconception: distractor maps to surface familiarity, not the grounded principle. Annotate the chunk and explain why the correct option follows from it.")
LOOSE_RIGHT = ('Correct — matches the grounded answer and the chunk: "{c110}…".', "No gap. Next: link this concept to a concrete example from the lecture.")
LOOSE_WRONG = ('Not aligned with the grounded answer "{e}". Grounded source: "{c120}…".', "Gap: shallow pattern match vs grounded reasoning. Re-read the chunk and justify the correct choice in one sentence.")
STRONG = ('Strong — you hit {m}/{n} key ideas ({k}) and track the grounded chunk: "{c100}…".', "Minor gap: expression depth — connect the idea to a concrete example to cement transfer.")
PARTIAL = ('Partial — {m}/{n} core ideas present but missing nuance: expected direction "{e120}…" (chunk: "{c90}…").', "Gap: incomplete conceptual chain. You covered {m} ideas yet missed the link the chunk stresses. Next: rewrite adding the missing link in one sentence.")
LOW = ('Grounded expectation: "{e140}…" (chunk: "{c100}…"). Your answer "{a120}…" diverges from that lineage.', "{w} Action: re-read the cited chunk, then explain the concept to a peer in 30s focusing on WHY.")
REASONS = {
    "overfitting": "Classic overfitting fallacy: training accuracy ≠ generalization — variance and validation matter per the chunk.",
    "paradigms": "Paradigms conflated: theory-driven (interpretable/low-data) vs data-driven (perceptual/large-data) — trade-off missed.",
    "iteration": "Feedback-loop rationale missed — single-pass cannot revise early errors per the iterative chunk.",
    "ungrounded": "Answer diverges from the grounded source — indicates retrieval without grounding.",
}


def gap_reason(concept_tag: Column, correct: Column) -> Column:
    """Why an answer of low coverage went wrong, by concept; the first that fits."""
    tag, expected = F.lower(F.coalesce(concept_tag, F.lit(""))), F.lower(F.coalesce(correct, F.lit("")))
    return (
        F.when(F.contains(tag, F.lit("overfit")) | F.contains(expected, F.lit("generalization")), "overfitting")
        .when(F.contains(tag, F.lit("paradigm")), "paradigms")
        .when(F.contains(tag, F.lit("iterat")), "iteration")
        .otherwise("ungrounded")
    )


def feedback(g: Grade, question_type: Column, correct: Column, concept_tag: Column, chunk: Column, answer: Column) -> tuple[Column, Column]:
    """(feedback, conceptual_gap): what the student is told of a graded answer, in the chunk's words."""
    texts = {"c": F.coalesce(chunk, F.lit("")), "e": F.coalesce(correct, F.lit("")), "a": F.coalesce(answer, F.lit(""))}
    plain = {"m": g.matched.cast("string"), "n": g.n_keywords.cast("string"), "k": F.array_join(F.slice(g.keywords, 1, 3), ", ")}
    reason = gap_reason(concept_tag, correct)
    plain["w"] = F.coalesce(*[F.when(reason == name, sentence) for name, sentence in REASONS.items()])

    def said(pattern: str) -> Column:
        parts = []
        for i, part in enumerate(re.split(r"\{(\w+)\}", pattern)):
            if i % 2 == 0:
                parts.append(F.lit(part))
            elif part in plain:
                parts.append(plain[part])
            else:
                text, size = texts[part[0]], part[1:]
                parts.append(F.left(text, F.lit(int(size))) if size else text)
        return F.concat(*parts)

    def told(which: int) -> Column:
        chosen = F.when(g.is_option, F.when(g.is_correct, said(OPTION_RIGHT[which])).otherwise(said(OPTION_WRONG[which])))
        loose = F.when(g.is_correct, said(LOOSE_RIGHT[which])).otherwise(said(LOOSE_WRONG[which]))
        by_words = F.when(g.coverage >= 0.85, said(STRONG[which])).when(g.coverage >= 0.65, said(PARTIAL[which])).otherwise(said(LOW[which]))
        mcq = F.coalesce(question_type, F.lit("")) == "mcq"
        return F.when(g.blank, said(BLANK[which])).when(mcq, F.coalesce(chosen, loose)).otherwise(by_words)

    return told(0), told(1)


def clamped(score: Column, points: Column) -> Column:
    return F.greatest(F.lit(0), F.least(points, score))


def percent(score: Column, total: Column) -> Column:
    """Whole percent, halves up; 0 where there is nothing to divide by."""
    return F.coalesce(F.floor(F.try_divide(score * F.lit(100.0), total) + 0.5), F.lit(0)).cast("int")


def performance_band(score: Column, total: Column) -> Column:
    share = F.coalesce(F.try_divide(score, total), F.lit(0.0))
    return F.when(share >= 0.8, "strong").when(share >= 0.5, "partial").otherwise("weak")


def coverage_band(percent_covered: Column) -> Column:
    return F.when(percent_covered >= 80, "high").when(percent_covered >= 60, "good").when(percent_covered >= 40, "fair").otherwise("low")


def default_points(difficulty: Column) -> Column:
    return F.when(difficulty == "Hard", 15).when(difficulty == "Easy", 5).otherwise(10)
