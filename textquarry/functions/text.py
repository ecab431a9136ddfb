"""Text scalars as Column expressions: measurement, masking, cleaning, classification and templates."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space by code point, and characters of which one, one and a half or two make a token; others: four.
WHITE = r"\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
CONTROL = r"\x{0}-\x{8}\x{E}-\x{1F}\x{7F}"
ONE = r"\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{2600}-\x{26FF}"
ONE_AND_HALF = r"\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}"
TWO = r"\x{600}-\x{6FF}\x{900}-\x{97F}\x{E00}-\x{E7F}\x{400}-\x{4FF}\x{370}-\x{3FF}\x{590}-\x{5FF}"

CJK = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{AC00}-\x{D7AF}\x{FF00}-\x{FFEF}"

# What mask_secrets hides (all but group 1), strip_ansi and sanitize_output delete.
SECRET = r"((?i:bearer |basic )|(?:password|token|key|secret|api_key|apikey|access_token|private_key)=)\S+|sk-\S*|AKIA[A-Za-z0-9]+|gh[posu]_[A-Za-z0-9]+"
ANSI = r"\x1B(?:\[[\x20-\x3F]*[\x40-\x7E]?)?"
UNSAFE = r"[\x{0}\x{80}-\x{9F}\x{202A}-\x{202E}\x{2028}\x{2029}\x{E0000}-\x{E007F}]"
MASK = "****"

# Failure classes and the patterns of each, in order; the first class that matches counts.
FAILURES = [
    ("lint_fail", [r"error\[E\d{4}\]"]),
    (
        "type_error",
        [
            "cannot find (value|function|type|module|struct|field|method)", "mismatched types?", "type mismatch", r"\bundefined\b", "is not (a |an )?(function|defined|iterable)",
            "expected .+, found", "no method named", "no (associated |)item named", "borrow of moved value", "use of moved value", "cannot borrow",
        ],
    ),
    ("syntax_error", ["syntax error", "unexpected token", "unexpected end of (file|input)", "parse error", "missing ';' or '}'", "expected .+ but found", "unclosed delimiter"]),
    ("test_fail", ["test .* failed", "assertion.*failed", "panic!.*at", "test result: FAILED", "1 failed", r"\bFAIL\b"]),
    ("lint_fail", ["clippy::", "warning: .*denied", "unused (import|variable|function)"]),
    ("build_fail", ["compilation failed", "build failed", "cargo build.*failed", "could not compile", "linking.*failed", "fatal error:"]),
    ("permission_denied", ["permission denied", "access denied", "EACCES", "EPERM", "operation not permitted"]),
    ("timeout", ["timed? ?out", "deadline exceeded", "ETIMEDOUT"]),
    ("not_found", ["not found", "ENOENT", "no such file", "404"]),
    ("runtime_error", ["runtime error", "segmentation fault", "stack overflow", "out of memory", "OOM", "panic!?"]),
]

# Injection signals as (label, weight, pattern), case-insensitive.
INJECTIONS = [
    ("instruction_override", 0.5, r"\b(ignore|disregard|forget)\b.{0,40}\b(previous|prior|above|earlier|all)\b.{0,40}\b(instructions?|prompts?|rules?|directives?)\b"),
    ("instruction_override", 0.5, r"\b(ignore|disregard|forget)\b.{0,80}\b(system|developer)\b.{0,40}\b(prompt|message|instruction)"),
    ("instruction_override", 0.5, r"\b(repeat|reveal|show|print|output|display|leak)\b.{0,40}\b(system|initial|hidden)\b.{0,20}\b(prompt|instructions?|rules?|directives?|message)"),
    ("role_hijack", 0.4, r"\b(you are now|from now on|pretend you are)\b"),
    ("role_hijack", 0.4, r"\bact as\b.{0,30}\b(developer|admin|root|administrator|root user|dan)\b"),
    ("role_hijack", 0.4, r"\bfrom now on\b.{0,40}\b(instructions?|rules?|prompts?)\b"),
    ("delimiter_escape", 0.4, r"<\|?(system|assistant|user|im_start|im_end|endoftext)\|?>"),
    ("delimiter_escape", 0.4, r"(^|\n)\s*#{1,3}\s*(system|assistant|user)\b"),
    ("delimiter_escape", 0.3, r"\bendoftext\b"),
    ("jailbreak", 0.5, r"\bDAN\b.{0,30}\b(do anything now)\b"),
    ("jailbreak", 0.4, r"\b(jailbreak|developer mode|god mode|unrestricted mode)\b"),
    ("payload_drop", 0.5, r"\bDROP\s+(TABLE|DATABASE)\b"),
    ("payload_drop", 0.5, r"\brm\s+-rf\b"),
]

#: Unicode classes and case folding, and only \n ends a line, as in the patterns' original dialect.
DIALECT = "(?Ud)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _openings(pattern: str) -> list[str]:
    """Lower-case strings of which a match of `pattern` must hold one: its opening literal, or those of its opening group."""
    p = re.sub(r"^\\b", "", pattern)
    group = re.match(r"\(([^()]*)\)", p)
    if group and not group[1].startswith(("^", "?")):
        return [x for o in group[1].split("|") for x in _openings(o)]
    literal = re.match(r"[A-Za-z0-9 _:!';<#-]+", p)
    if literal is None:
        return ["#"] if "#{" in p else []
    return [(literal[0][:-1] if p[literal.end() : literal.end() + 1] in ("?", "*") else literal[0]).lower()]


def matches(text: Column, patterns: list[str]) -> Column:
    """Does one of the patterns (case-insensitive) match? Cheap substring tests keep most texts from the regular expressions;
    the long s, which folds to s but has no lower-case form, goes to them."""
    low, tests = F.lower(text), []
    for p in patterns:
        near = [F.contains(low, F.lit(x)) for x in _openings(p)]
        full = text.rlike(f"{DIALECT}(?i){p}")
        tests.append(reduce(lambda a, b: a | b, [*near, F.contains(low, F.lit("ſ"))]) & full if near else full)
    return reduce(lambda a, b: a | b, tests)


def estimate_tokens(text: Column | str) -> Column:
    """Script-aware token estimate: 0 for null, empty or control-only texts, else at least 1."""
    t = F.coalesce(_col(text), F.lit(""))
    n = lambda cls: F.regexp_count(t, F.lit(f"[{cls}]"))
    one, mid, two, none = n(ONE), n(ONE_AND_HALF), n(TWO), n(CONTROL)
    total = (F.length(t) - one - mid - two - none) / 4.0 + one + mid / 1.5 + two / 2.0
    return F.when(total == 0, 0).otherwise(F.greatest(F.lit(1), F.round(total).cast("int"))).cast("int")


def estimate_tokens_min(text: Column | str, least: int) -> Column:
    return F.greatest(estimate_tokens(text), F.lit(least))


def trim_white(text: Column | str) -> Column:
    """Trim Unicode white space."""
    return F.regexp_replace(_col(text), f"^[{WHITE}]+|[{WHITE}]+$", "")


def segment(text: Column | str) -> Column:
    """Sentences: cut after . ! ? and their full-width forms and at line ends; trimmed, empty ones dropped."""
    parts = F.split(F.regexp_replace(_col(text), "([.!?。！？])", "$1\n"), "[\r\n]")
    return F.filter(F.transform(parts, trim_white), lambda s: s != "")


def text_preview(text: Column | str, chars: int = 64) -> Column:
    t = _col(text)
    return F.when(F.length(t) > chars, F.concat(F.left(t, F.lit(chars)), F.lit("…"))).otherwise(t)


def mask_secrets(text: Column | str) -> Column:
    """Bearer/Basic values, key=value secrets and well-known token shapes become ****; prefixes stay."""
    return F.regexp_replace(_col(text), f"{DIALECT}{SECRET}", "$1" + MASK.replace("*", r"\*"))


def strip_ansi(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), ANSI, "")


def sanitize_output(text: Column | str) -> Column:
    """Without NUL, C1 controls, direction overrides, line and paragraph separators and tag characters."""
    return F.regexp_replace(_col(text), UNSAFE, "")


def classify_failure(message: Column | str) -> Column:
    m, out = F.coalesce(_col(message), F.lit("")), F.lit("unknown")
    for label, patterns in reversed(FAILURES):
        out = F.when(matches(m, patterns), label).otherwise(out)
    return out


def injection_score(text: Column | str) -> Column:
    """Sum of the weights of all rules that match, 1 at most."""
    t = F.coalesce(_col(text), F.lit(""))
    total = sum((F.when(matches(t, [p]), w).otherwise(0.0) for _, w, p in INJECTIONS), F.lit(0.0))
    return F.least(F.round(total, 4), F.lit(1.0))


def injection_labels(text: Column | str) -> Column:
    t = F.coalesce(_col(text), F.lit(""))
    return F.array_distinct(F.array_compact(F.array(*(F.when(matches(t, [p]), label) for label, _, p in INJECTIONS))))


def redact_credential(value: Column | str) -> Column:
    v = _col(value)
    return F.when(v == "", "").when(F.length(v) <= 8, MASK).otherwise(F.concat(F.left(v, F.lit(4)), F.lit(MASK), F.right(v, F.lit(4))))


def is_uuid4(value: Column | str) -> Column:
    return F.coalesce(_col(value).rlike(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-4[0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$"), F.lit(False))


def is_env_key(name: Column | str) -> Column:
    return F.coalesce(_col(name).rlike(r"^[A-Za-z_][A-Za-z0-9_]*$"), F.lit(False))


def render_prompt(template: Column | str, values: dict[str, Column | str]) -> Column:
    """{{name}} by value, one name after the other: a later one also applies to what an earlier one brought in."""
    out = _col(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), value if isinstance(value, Column) else F.lit(value))
    return out


def template_variables(template: Column | str) -> Column:
    """Distinct names between {{ and }}, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(_col(template), F.lit(r"(?s)\{\{(.*?)\}\}"), F.lit(1)))


def render_template(shots: Column, body: Column | str, values: dict[str, Column | str]) -> Column:
    """Few-shot lines (an array of strings), then the body, each on lines of their own."""
    return F.array_join(F.concat(F.coalesce(shots, F.array().cast("array<string>")), F.array(render_prompt(body, values))), "\n")


def extract_xml_tag(text: Column | str, tag: str) -> Column:
    """What stands between the first <tag> and the next </tag>, trimmed; null where there is none."""
    t, a, b = _col(text), f"<{tag}>", f"</{tag}>"
    rest = F.substring(t, F.instr(t, F.lit(a)) + len(a), F.length(t))
    return F.when((F.instr(t, F.lit(a)) > 0) & (F.instr(rest, F.lit(b)) > 0), trim_white(F.substring(rest, F.lit(1), F.instr(rest, F.lit(b)) - 1)))


def redact_url_credentials(text: Column | str) -> Column:
    """user:password@ of urls becomes ****@."""
    return F.regexp_replace(_col(text), r"(\w+://)[^/\s@]+@", r"$1\*\*\*\*@")


def segment_cjk(text: Column | str) -> Column:
    """A space after each CJK character, so that each is a term of its own."""
    return F.regexp_replace(_col(text), f"([{CJK}])", "$1 ")
