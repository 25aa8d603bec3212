"""Text expressions: cleaning, guards, tokens, prompts, keys and classification.

All of them are built-in column functions. Words are runs of characters that are not
white space in Unicode's sense, as Python's split() counts them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .numbers import exact_round


def _any(conditions: list[Column]) -> Column:
    return reduce(Column.__or__, conditions)


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0))


def strip(text: Column) -> Column:
    """Text without white space at its ends; trim() takes blanks alone."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"(?U)\S")


def remove_fillers(text: Column) -> Column:
    """Without standalone fillers, a comma and the white space after them (which may be a line feed)."""
    return F.regexp_replace(text, r"(?iU)\b(" + "|".join(rules.FILLERS) + r")\b[,]?\s*", "")


def clean_whitespace(text: Column) -> Column:
    """Runs of blanks as one, lines stripped, blank lines gone."""
    lines = F.transform(F.split(text, "\n"), lambda line: strip(F.regexp_replace(line, "  +", " ")))
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def clean(text: Column, fillers: bool = False) -> Column:
    """The cleaning steps after labelling; a blank text gives an empty one."""
    return F.when(is_blank(text), "").otherwise(clean_whitespace(remove_fillers(text) if fillers else text))


def too_short(text: Column, words: int = rules.MIN_WORDS, characters: int = rules.MIN_CHARS) -> Column:
    """Whether a transcript has too little in it to be judged."""
    bare = strip(F.coalesce(text, F.lit("")))
    return (bare == "") | (word_count(text) < words) | (F.length(bare) < characters)


def input_error(text: Column, most: int = rules.MAX_CHARS) -> Column:
    """Why a transcript cannot be sent: empty, nul_bytes or too_long; null if it can."""
    return F.when(is_blank(text), "empty").when(text.contains("\x00"), "nul_bytes").when(F.length(text) > most, "too_long")


def token_estimate(text: Column) -> Column:
    """Tokens by words, truncated."""
    return F.floor(word_count(text) * F.lit(rules.TOKENS_PER_WORD)).cast("int")


def token_analysis(text: Column, max_tokens: int, price_in: float, price_out: float, tokens_out: int = 1500) -> Column:
    """struct(token_count, needs_truncation, excess_tokens, estimated_cost_usd)."""
    n = token_estimate(text)
    return F.struct(
        n.alias("token_count"),
        (n > max_tokens).alias("needs_truncation"),
        F.greatest(F.lit(0), n - max_tokens).alias("excess_tokens"),
        exact_round(n / 1_000_000 * price_in + F.lit(tokens_out / 1_000_000 * price_out), 4).alias("estimated_cost_usd"),
    )


def basename(path: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path, "/+$", ""), "[^/]*$", 0)


def safe_filename(path: Column) -> Column:
    """Stem in word characters and dashes, six hex digits of the name's SHA-256, suffix."""
    name = basename(path)
    suffix = F.regexp_extract(name, r"^.*[^.].*?(\.[^.]+)$", 1)
    suffix = F.when(name.rlike(r"^\.[^.]*$"), "").otherwise(suffix)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(suffix))
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace(stem, r"(?U)[^\w\-]", "_"), "_+", "_"), "^_|_$", "")
    return F.when(path.isNull() | (path == ""), "unknown").otherwise(F.concat(safe, F.lit("_"), F.substring(F.sha2(name.cast("binary"), 256), 1, 6), suffix))


def llm_cache_key(transcript: Column, call_type: Column, n_criteria: Column, model: str, criteria_hash: Column, prompt_hash: Column, temperature: str = "0.1") -> Column:
    return F.sha2(F.concat_ws("|", F.lit(model), call_type, n_criteria.cast("string"), criteria_hash, prompt_hash, F.lit(temperature), transcript).cast("binary"), 256)


def stt_cache_key(content: Column, model: str, diarize: bool, speakers: int | None, language: str | None) -> Column:
    settings = f"|{model}|{diarize}|{speakers}|{language}"
    return F.sha2(F.concat(content, F.encode(F.lit(settings), "UTF-8")), 256)


def render(template: str, values: dict[str, Column], strict: bool = False) -> Column:
    """A template with {name} fields filled; unknown fields stay, or fail if strict.

    Braces of a value named transcript are doubled and stay doubled. Values are put in
    between the template's own parts, so a value that looks like a field is not filled.
    """
    import re

    parts: list[Column] = []
    for piece in re.split(r"(\{\{|\}\}|\{\w+\})", template):
        if piece in ("{{", "}}"):
            parts.append(F.lit(piece[0]))
        elif piece.startswith("{") and piece.endswith("}") and len(piece) > 2:
            name = piece[1:-1]
            if name not in values:
                if strict:
                    raise KeyError(f"the template asks for {name}")
                parts.append(F.lit(piece))
            elif name == "transcript":
                parts.append(F.replace(F.replace(values[name], F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}")))
            else:
                parts.append(values[name].cast("string"))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def call_type(result: Column, status: Column, filename: Column, transcript: Column) -> Column:
    """Follow-up Call or First Call: by result, status, file name, then the first 1000 characters."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    head = F.lower(F.substring(F.coalesce(transcript, F.lit("")), 1, 1000))
    follow = (
        low(result).isin(rules.FOLLOW_UP_RESULTS)
        | _any([low(status).contains(s) for s in rules.FOLLOW_UP_STATUS])
        | _any([low(filename).contains(s) for s in rules.FOLLOW_UP_FILES])
        | _any([head.contains(s) for s in rules.FOLLOW_UP])
    )
    return F.when(follow, "Follow-up Call").otherwise("First Call")


def agent_names(transcript: Column) -> Column:
    """Distinct names that Agent: lines introduce, in order of appearance."""
    lines = F.filter(F.split(F.coalesce(transcript, F.lit("")), "\n"), lambda line: F.lower(line).startswith("agent:"))
    found = F.flatten(F.transform(lines, lambda line: F.array(*[F.lower(F.regexp_extract(line, "(?iU)" + p, 1)) for p in rules.NAME_INTRO])))
    kept = F.filter(found, lambda n: (n != "") & ~n.isin(rules.NO_NAMES) & ~(n.endswith("ing") & (F.length(n) > 3)))
    return F.transform(F.array_distinct(kept), lambda n: F.concat(F.upper(F.substring(n, 1, 1)), F.substring(n, 2, 1 << 20)))


def error_class(status: Column, message: Column) -> Column:
    """What kind of failure a provider's answer is."""
    text = F.lower(F.coalesce(message, F.lit("")))
    has = lambda *words: _any([text.contains(w) for w in words])
    is_ = lambda n: F.coalesce(status == n, F.lit(False))
    return (
        F.when(is_(401) | has("authentication", "invalid api key"), "invalid_config")
        .when(is_(402) | has("can only afford", "requires more credits"), "quota_exhausted")
        .when(is_(429), F.when(has("quota", "billing", "exceeded"), "quota_exhausted").otherwise("rate_limit"))
        .when(F.coalesce(status >= 500, F.lit(False)), "server_error")
        .when(has("model") & has("not found", "does not exist", "not a valid"), "invalid_config")
        .otherwise("unknown")
    )


def audio_format(content: Column) -> Column:
    """Format by first bytes; null if they are unknown."""
    head = F.hex(F.substring(content, 1, 4))
    out = F.lit(None).cast("string")
    for magic, name in reversed(rules.MAGIC.items()):
        out = F.when(head.startswith(magic), name).otherwise(out)
    return out


def audio_error(content: Column, most: int = rules.MAX_FILE_BYTES) -> Column:
    """missing, empty or too_large; null for a file that can be sent."""
    n = F.octet_length(content)
    return F.when(content.isNull(), "missing").when(n == 0, "empty").when(n > most, "too_large")


def stt_status(seconds: Column, least: float = 5.0) -> Column:
    """skipped_short for audio that is too short to be sent, else pending. A short file
    still counts as a success and is billed by the estimate."""
    return F.when(seconds < least, "skipped_short").otherwise("pending")


def host(url: Column) -> Column:
    """Host of a URL in lower case, without user and port; null if there is none."""
    got = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    return F.nullif(got, F.lit(""))


def spelled_out(text: Column, loose: bool = False) -> Column:
    """Whether a word is spelled letter by letter."""
    return text.rlike("(?iU)" + (rules.SPELLED_LOOSE if loose else rules.SPELLED))


def hold_language(line: Column) -> Column:
    return line.rlike("(?i)" + rules.HOLD)


def warnings(truncated_pct: Column, pii_count: Column, method: Column) -> Column:
    """The warnings that go with an evaluation, in a fixed order."""
    every = F.array(
        F.when(truncated_pct.isNotNull(), F.concat(F.lit("TRUNCATED: "), truncated_pct.cast("string"), F.lit("% of transcript removed"))),
        F.when(pii_count > 0, F.concat(F.lit("PII_IN_EVIDENCE: "), pii_count.cast("string"), F.lit(" criteria affected"))),
        F.when(method == "direction", F.lit("LOW_CONFIDENCE_SPEAKER: direction-based heuristic used")),
    )
    return F.filter(every, lambda w: w.isNotNull())


def edge_trim(original_ms: Column, first_ms: Column, last_ms: Column, padding: int = 500, least_pct: float = 5.0) -> Column:
    """struct(start_ms, end_ms, savings_pct, action) of cutting silence off both ends.

    first_ms and last_ms bound what is not silent; nulls mean that everything is silent.
    """
    start = F.greatest(F.lit(0), first_ms - padding)
    end = F.least(original_ms, last_ms + padding)
    saved = exact_round((1 - (end - start) / F.greatest(F.lit(1), original_ms)) * 100, 1)
    silent = first_ms.isNull() | last_ms.isNull()
    return F.struct(
        F.when(~silent, start).alias("start_ms"),
        F.when(~silent, end).alias("end_ms"),
        F.when(silent, F.lit(100.0)).otherwise(saved).alias("savings_pct"),
        F.when(silent, "all_silence").when(saved < least_pct, "no_change").otherwise("preprocessed").alias("action"),
    )


def valid_date(text: Column, as_of: Column) -> Column:
    """Whether a text is a date (year-month-day) that is not after as_of."""
    day = F.try_to_timestamp(text, F.lit("yyyy-M-d")).cast("date")
    return F.coalesce(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") & (day <= as_of), F.lit(False))
