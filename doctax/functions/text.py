"""Text functions as column expressions. All are null-safe: a null text gives null unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that Python's ``str.split`` splits at, for regular expressions of both Java and RE2.
BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# Id prefixes in the order in which they are tried, and phrases that speak of agents.
TAXONOMY_PREFIXES = (
    ("ai-risk-taxonomy-", "ai-risk-taxonomy"),
    ("atlas-", "ibm-risk-atlas"),
    ("credo-", "credo-ucf"),
    ("mit-ai-risk-", "mit-ai-risk-repository"),
    ("mit-ai-causal-", "mit-ai-risk-repository-causal"),
    ("nist-", "nist-ai-rmf"),
    ("ail-", "ailuminate-v1.0"),
    ("granite-", "ibm-granite-guardian"),
    ("llm", "owasp-llm-2.0"),
    ("asi0", "owasp-asi"),
    ("shieldgemma-", "shieldgemma-taxonomy"),
)
AGENTIC_PHRASES = (
    "agentic", "ai agent", "ai agents", "autonomous agent", "autonomous agents", "agent framework", "tool-calling", "tool calling",
    "function calling", "agentic ai", "agentic system", "agentic systems", "multi-agent", "multiagent",
)
# Words without content.
STOPWORDS = ("a", "an", "the", "of", "for", "in", "on", "to", "and", "or", "by", "with", "is", "are", "be", "that", "this", "from", "at", "as")
DEFINITION = " is defined as "


def tokens(text: Column) -> Column:
    """Lower-case words between blanks, punctuation kept."""
    return F.filter(F.split(F.lower(text), BLANK + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(tokens(text)).cast("bigint")


def sentences(text: Column) -> Column:
    """Runs that end in a mark of sentence end; blank ones fall away."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"[^.!?。！？]+[.!?。！？]*"), F.lit(0)), lambda s: F.trim(s) != "")


def bare_id(risk_id: Column) -> Column:
    """An id without what follows its first blank."""
    return F.trim(F.split_part(risk_id, F.lit(" "), F.lit(1)))


def variant_parent(risk_id: Column) -> Column:
    """What stands before the last ``---``; null if there is none."""
    return F.nullif(F.regexp_extract(risk_id, r"^(.*)---", 1), F.lit(""))


def taxonomy_of(risk_id: Column, prefixes: tuple[tuple[str, str], ...] = TAXONOMY_PREFIXES) -> Column:
    """The taxonomy of the first prefix that fits, else ``unknown``."""
    return reduce(lambda other, rule: F.when(risk_id.startswith(rule[0]), F.lit(rule[1])).otherwise(other), reversed(prefixes), F.lit("unknown"))


def speaks_of_agents(text: Column) -> Column:
    """Whether the text has one of the phrases."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(p)) for p in AGENTIC_PHRASES))


def estimated_tokens(text: Column) -> Column:
    return F.floor(F.coalesce(F.length(text), F.lit(0)) / 3)


def message_tokens(messages: Column) -> Column:
    """Estimate for an array of ``(role, content)``."""
    return F.aggregate(messages, F.lit(2).cast("bigint"), lambda n, m: n + 4 + estimated_tokens(m["content"]))


def output_budget(input_tokens: Column, max_context: int, wanted: int, overhead: int = 500, margin: int = 64, least: int = 256) -> Column:
    """Tokens left for the answer; the wanted number if the context isn't limited."""
    if max_context <= 0:
        return F.lit(wanted).cast("bigint")
    left = F.lit(max_context) - input_tokens - overhead - margin
    return F.when(left < least, F.lit(least)).otherwise(F.least(F.lit(wanted), left)).cast("bigint")


def truncated_length(longest: Column, factor: float = 0.6, least: int = 500) -> Column:
    """Characters kept of the longest user message; null if it can't be made shorter."""
    return F.when(longest > least, F.greatest(F.floor(longest * factor), F.lit(least)).cast("bigint"))


def reduced_output(message: Column, margin: int = 32, least: int = 256) -> Column:
    """The smaller output limit that an overflow message allows; null if it says none or too little."""
    pattern = r"maximum context length is (\d+) tokens.*?(\d+) output tokens.*?(\d+) input tokens"
    last = lambda g: F.try_element_at(F.regexp_extract_all(message, F.lit(pattern), F.lit(g)), F.lit(-1)).cast("bigint")
    left = last(1) - last(3) - margin
    return F.when(left >= least, left)


def normalised(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def evidence_overlap(evidence: Column, chunk: Column) -> Column:
    """The share of the evidence's words that the chunk has."""
    words = F.array_distinct(tokens(evidence))
    return F.when(F.size(words) > 0, F.size(F.array_intersect(words, tokens(chunk))) / F.size(words)).otherwise(F.lit(0.0))


def token_f1(one: Column, two: Column) -> Column:
    """Harmonic mean of precision and recall of two word sets."""
    a, b = F.array_distinct(tokens(one)), F.array_distinct(tokens(two))
    common = F.size(F.array_intersect(a, b))
    return F.when(common > 0, 2.0 * common / (F.size(a) + F.size(b))).otherwise(F.lit(0.0))


def content_tokens(name: Column) -> Column:
    return F.array_except(F.regexp_extract_all(F.lower(name), F.lit("[a-z0-9]+"), F.lit(0)), F.array(*map(F.lit, STOPWORDS)))


def content_overlap(one: Column, two: Column) -> Column:
    a, b = content_tokens(one), F.array_distinct(content_tokens(two))
    most = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / most).otherwise(F.lit(0.0))


def cleaned_description(name: Column, description: Column) -> Column:
    """A description without a leading ``<name> is defined as`` and one ``if``, ``whether`` or ``the`` each after it."""
    head = F.lower(F.concat(name, F.lit(DEFINITION)))
    rest = F.substring(description, F.length(name) + len(DEFINITION) + 1, F.length(description))
    rest = F.regexp_replace(rest, r"^(?:if )?(?:whether )?(?:the )?", "")
    return F.when(F.startswith(F.lower(description), head), rest).otherwise(F.coalesce(description, F.lit("")))


def instructed(text: Column, instruction: str = "") -> Column:
    """A query with the instruction that some encoders want; entries are encoded without it."""
    return F.concat(F.lit(f"Instruct: {instruction}\nQuery:"), text) if instruction else text


def preview(text: Column, size: int = 200) -> Column:
    return F.substring(text, 1, size)


def slug(text: Column, size: int = 40) -> Column:
    """Letters and digits of a text, joined by hyphens, for file names."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, size)


def elapsed(seconds: Column) -> Column:
    """``1m 05s``, or ``5s`` below a minute."""
    whole = F.floor(seconds).cast("bigint")
    return F.when(whole < 60, F.concat(whole.cast("string"), F.lit("s"))).otherwise(F.format_string("%dm %02ds", F.floor(whole / 60).cast("bigint"), (whole % 60).cast("bigint")))
