"""Column functions on text: words, identifiers, normal forms, digests, rules and predicates.

All are built-in expressions. Null text gives null, unless a docstring says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

NON_WORD = r"[^\p{L}\p{Nd}]+"


def words(text: Column) -> Column:
    """Lower-case runs of letters and decimal digits, in order, repeats kept."""
    return F.filter(F.split(F.lower(text), NON_WORD), lambda w: w != "")


def identifier_tokens(text: Column) -> Column:
    """words() with camel case and the ends of acronyms cut first."""
    cut = F.regexp_replace(text, r"(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})", " ")
    return words(cut)


def normalize_text(text: Column) -> Column:
    return F.array_join(identifier_tokens(text), " ")


def code_terms(text: Column) -> Column:
    """Runs of letters and numbers after a cut between an ASCII letter or digit and a capital."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def collapse(text: Column) -> Column:
    """White space runs as one space, trimmed; case stays. The normal form of code."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_query(text: Column) -> Column:
    return collapse(F.lower(text))


def text_digest(text: Column) -> Column:
    return F.sha2(text, 256)


def framed_list_digest(values: Column) -> Column:
    """Digest of the sorted values, each framed as `byte length:value` and a line feed."""
    frames = F.transform(F.sort_array(values), lambda v: F.concat(F.octet_length(v).cast("string"), F.lit(":"), v, F.lit("\n")))
    return F.sha2(F.array_join(frames, ""), 256)


def adjacent(tokens: Column, joiner: str) -> Column:
    """Adjacent pairs of an array's elements, joined."""
    n = F.size(tokens)
    return F.when(n > 1, F.zip_with(F.slice(tokens, 1, n - 1), F.slice(tokens, 2, n - 1), lambda a, b: F.concat(a, F.lit(joiner), b))).otherwise(
        F.array().cast("array<string>")
    )


def term_bigrams(tokens: Column) -> Column:
    """The tokens, then their adjacent pairs `a_b`."""
    return F.concat(tokens, adjacent(tokens, "_"))


def char_trigrams(tokens: Column) -> Column:
    """Distinct trigrams of `^token$`."""

    def grams(token: Column) -> Column:
        marked = F.concat(F.lit("^"), token, F.lit("$"))
        return F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: F.substring(marked, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(F.filter(tokens, lambda t: t != ""), grams)))


def declared_name(code: Column) -> Column:
    """The identifier after the first def, func or function; empty if none."""
    return F.regexp_extract(code, r"(?:^|[^\p{L}\p{Nd}_])(?:def|func|function)[^\p{L}\p{Nd}_]+([\p{L}\p{Nd}_]+)", 1)


def symbol_tokens(text: Column) -> Column:
    """words() together with comparison signs, brackets and parentheses."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{Nd}]+|<=|>=|[<>\[\]()]"), F.lit(0))


def in_scope(query: Column, code: Column, most_bytes: int = 4096, most_words: int = 64) -> Column:
    """Whether both texts keep the byte and the word limit."""
    fits = lambda t: (F.octet_length(t) <= most_bytes) & (F.size(words(t)) <= most_words)
    return fits(query) & fits(code)


def canonical_path(path: Column) -> Column:
    """Whether a path is relative, clean and short enough to be a catalog key."""
    parts = F.split(path, "/")
    clean = ~F.exists(parts, lambda p: p.isin("", ".", ".."))
    return (path != "") & (F.octet_length(path) <= 4096) & ~F.contains(path, F.lit("\x00")) & clean


#: Extensions of files that are read, and folders that aren't.
EXTENSIONS = ("go", "py", "rs", "js", "jsx", "ts", "tsx", "java", "c", "h", "cpp", "swift", "kt", "rb", "sh", "md", "json", "yaml", "yml", "toml")
EXCLUDED_FOLDERS = ("node_modules", "vendor", "dist", "build", "target", "__pycache__")


def safe_path(path: Column) -> Column:
    """Whether a path names a readable source file: no hidden, excluded, credential-like or lock file."""
    parts = F.split(path, "/")
    base = F.lower(F.element_at(parts, -1))
    bad_part = F.exists(parts, lambda p: F.startswith(p, F.lit(".")) | p.isin(*EXCLUDED_FOLDERS))
    bad_base = base.rlike(r"secret|credential|^id_rsa|lock\.json$")
    return ~F.startswith(path, F.lit("/")) & ~F.contains(path, F.lit("\\")) & ~bad_part & ~bad_base & F.regexp_extract(base, r"\.([^.]*)$", 1).isin(*EXTENSIONS)


def is_license_name(path: Column) -> Column:
    return F.upper(path).rlike(r"^(LICENSE|LICENSE[.-].*|COPYING|COPYING\..*|NOTICE|NOTICE\..*)$")


def exclusion_reason(query: Column, code: Column, file: Column, in_notice_folder: Column) -> Column:
    """The first of code, generated, notice, header, query that excludes a row; empty if none does."""
    header = F.substring_index(file, "package ", 1)
    asked = normalize_query(query)
    return (
        F.when(~F.contains(file, code), "code")
        .when(header.rlike("(?i)(code generated|generated by|do not edit)"), "generated")
        .when(in_notice_folder, "notice")
        .when(~F.contains(header, F.lit("Apache License")) & header.rlike("(?i)(license|copyright)"), "header")
        .when((asked == "") | F.contains(normalize_query(code), asked), "query")
        .otherwise("")
    )


def question_cue(text: Column, role: Column, most_bytes: int = 4096) -> Column:
    """struct(guard, question): whether prose has a question mark outside code and URIs.

    Guards come in order: size, role, unbalanced code; a guarded text has no cue (null).
    """
    prose = F.regexp_replace(text, r"(?s)(?<!`)(`+)(?!`)(?:.*?[^`])\1(?!`)", " ")
    bare = F.regexp_replace(prose, r"(?i)(?<![\p{L}\p{N}])(?:[a-z][a-z0-9+.-]*://|www\.|mailto:)\S*", " ")
    guard = (
        F.when(F.octet_length(text) > most_bytes, "text_limit")
        .when(role != "prose", "role_not_prose")
        .when(F.contains(prose, F.lit("`")), "unbalanced_code")
        .otherwise("")
    )
    return F.struct(guard.alias("guard"), F.when(guard == "", F.contains(bare, F.lit("?")) | F.contains(bare, F.lit("？"))).alias("question"))


#: The vocabulary of the keyword rules, in the order of the intents.
INTENT_PHRASES = {
    "question": ("how", "why", "which", "could you", "can you", "어떻게", "왜", "질문", "알려줘", "나요", "까요"),
    "blocker": ("blocked", "blocker", "cannot", "can't", "error", "failure", "broken", "stuck", "막혔", "막혀", "오류", "실패", "불가능", "대기 중", "기다리고"),
    "reference": ("reference", "documentation", "manual", "attachment", "attached", "https://", "http://", "참고", "자료", "문서", "첨부", "링크"),
    "progress": ("started", "working", "in progress", "implementing", "investigating", "시작했", "진행 중", "진행중", "작업 중", "처리 중", "확인 중"),
    "completion_report": ("completed", "finished", "done", "resolved", "완료했", "완료됐", "완료되었", "해결했", "끝났", "마쳤"),
    "cancel_request": ("cancel", "cancelled", "stop this", "abandon", "취소", "중단해", "그만해"),
    "planned": ("plan", "planned", "will", "tomorrow", "next week", "예정", "계획", "내일", "다음 주", "할게", "하겠"),
}
NOT_COMPLETED = ("not done", "not completed", "not finished", "incomplete", "아직 완료", "완료되지", "완료하지", "미완료", "끝나지")


def phrase_pattern(phrases: tuple[str, ...]) -> str:
    """ASCII phrases match between other characters than letters and numbers, others anywhere.

    No lookaround, so that other engines can run it: a phrase's neighbours are part of the match.
    """
    escape = lambda p: p.replace(".", r"\.").replace("?", r"\?")
    plain = [escape(p) for p in phrases if p.isascii()]
    other = [p for p in phrases if not p.isascii()]
    bounded = rf"(?:^|[^\p{{L}}\p{{N}}])(?:{'|'.join(plain)})(?:$|[^\p{{L}}\p{{N}}])"
    return "|".join([bounded, *other])


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is computed once, however often use names it."""
    return F.get(F.transform(F.array(value), use), 0)


def _any_of(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, (F.contains(text, F.lit(p)) for p in parts))


def phrases_occur(lower: Column, phrases: tuple[str, ...]) -> Column:
    """phrase_pattern(phrases) in a text, looked for only where a plain search has found one."""
    plain, other = tuple(p for p in phrases if p.isascii()), tuple(p for p in phrases if not p.isascii())
    here = _any_of(lower, plain) & lower.rlike(phrase_pattern(plain))
    return here | _any_of(lower, other) if other else here


def rule_intent(text: Column) -> Column:
    """The one intent whose phrases occur; unclear if none or several do, or completion is negated."""

    def decide(lower: Column) -> Column:
        flags = {i: phrases_occur(lower, p) for i, p in INTENT_PHRASES.items()}
        flags["question"] = F.contains(lower, F.lit("?")) | flags["question"]
        return F.array_compact(F.array(*(F.when(flag, i) for i, flag in flags.items()), F.when(phrases_occur(lower, NOT_COMPLETED), "negated")))

    return once(once(F.lower(text), decide), lambda found: F.when(F.array_contains(found, "negated") | (F.size(found) != 1), "unclear").otherwise(F.get(found, 0)))


#: The terms of the speech act rules.
ACT_TERMS = {
    "framed": ("hypothetical", "suppose ", "if we ", "if the ", "would be", "만약", "가정하", "예를 들", "라고 썼", "라고 했", "인용", "quoted", "the message says", "someone said"),
    "question": ("?", "？", "please explain", "could you explain", "can you explain", "how do ", "how can ", "why does ", "what is ", "what does ", "is it ", "알려 주", "알려주", "설명해", "설명해 주", "어떻게", "무엇", "왜 ", "언제 ", "인가요", "있나요", "맞나요", "할까요"),
    "cancel": ("please cancel", "cancel this", "cancel the ", "withdraw this", "withdraw the ", "취소해", "취소하겠", "취소 부탁", "철회해", "중단해 주세요", "중단해주세요"),
    "blocked": ("blocked", "cannot proceed", "can't proceed", "unable to continue", "waiting for access", "missing permission", "진행할 수 없", "진행이 불가능", "막혔", "권한이 없", "권한을 기다", "응답을 기다", "승인을 기다", "접근할 수 없"),
    "active": ("working on", "currently implementing", "currently reviewing", "still working", "in progress", "진행 중", "진행중", "작업 중", "작업중", "검토 중", "검토중", "구현 중", "처리 중"),
    "not_done": ("not done", "not finished", "not completed", "isn't finished", "hasn't finished", "완료되지", "완료하지 못", "끝나지", "마무리하지 못", "아직 남", "remaining work", "still pending"),
    "done": ("completed", "finished", "done now", "all done", "delivered", "submitted", "완료했", "완료됐", "완료되었", "끝냈", "끝났", "마쳤", "마무리했", "모두 처리했"),
    "plan": ("will start", "plan to ", "planning to ", "scheduled for", "tomorrow i ", "next week i ", "할 예정", "시작할 예정", "계획입니다", "계획이야", "계획 중", "아직 시작하지", "내일 시작", "다음 주 시작"),
    "reference": ("for reference", "reference material", "here is the ", "attached is", "sharing the ", "sharing a ", "documentation link", "참고자료", "참고 자료", "참고용", "자료를 공유", "링크를 공유", "첨부합니다", "문서를 공유"),
}


def any_term_pattern(terms: tuple[str, ...]) -> str:
    return "|".join(t.replace("?", r"\?") for t in terms)


def rule_speech_act(text: Column) -> Column:
    """Hypothetical framing, then questions, then cancelling, then the one act that is claimed."""
    return once(F.lower(F.trim(text)), lambda lower: once(F.struct((lower == "").alias("empty"), *(_any_of(lower, terms).alias(name) for name, terms in ACT_TERMS.items())), _decide_act))


def _decide_act(has: Column) -> Column:
    """The act of a struct of flags, one for each list of terms."""
    acts = {"blocker": has["blocked"], "progress": has["active"], "completion_report": has["done"] & ~has["not_done"], "planned": has["plan"], "reference": has["reference"]}
    found = F.array_compact(F.array(*(F.when(flag, act) for act, flag in acts.items())))
    torn = has["done"] & (has["not_done"] | has["active"] | has["blocked"] | has["plan"])
    return (
        F.when(has["empty"] | has["framed"], "unclear")
        .when(has["question"], "question")
        .when(has["cancel"], "cancel_request")
        .when(torn, F.when(has["not_done"] & has["active"] & ~has["blocked"] & ~has["plan"], "progress").otherwise("unclear"))
        .when(F.size(found) == 1, F.get(found, 0))
        .otherwise("unclear")
    )


def script_guard(text: Column) -> Column:
    """struct(other_script, hangul): letters outside Latin, and Korean ones."""
    return F.struct(text.rlike(r"[\p{L}&&[^\p{IsLatin}]]").alias("other_script"), text.rlike(r"\p{IsHangul}").alias("hangul"))


def length_buckets(text: Column) -> Column:
    """struct(bytes, characters): the first limit that the length keeps, null beyond the last."""

    def bucket(size: Column, limits: tuple[int, ...]) -> Column:
        out = F.when(size <= limits[0], limits[0])
        for limit in limits[1:]:
            out = out.when(size <= limit, limit)
        return out

    return F.struct(bucket(F.octet_length(text), (64, 128, 256, 4096)).alias("bytes"), bucket(F.char_length(text), (16, 32, 64, 4096)).alias("characters"))


def span_state(text: Column, start: Column, end: Column) -> Column:
    """outside, split_character, blank or ok for the byte span [start, end) of a text."""
    raw = F.encode(text, "UTF-8")
    size = F.octet_length(text)

    def splits(at: Column) -> Column:  # a continuation byte, 0x80 to 0xBF, can't start a span
        return (at > 0) & (at < size) & F.hex(F.substring(raw, at + 1, F.lit(1))).rlike("^[89AB]")

    part = F.decode(F.substring(raw, start + 1, end - start), "UTF-8")
    return (
        F.when((start < 0) | (end > size) | (start >= end), "outside")
        .when(splits(start) | splits(end), "split_character")
        .when(F.trim(part) == "", "blank")
        .otherwise("ok")
    )


def valid_emoji_code(code: Column) -> Column:
    """Hyphen-joined lower-case code points of at least four digits, none a control or a surrogate."""
    parts = F.split(code, "-")

    def valid(p: Column) -> Column:
        value = F.conv(p, 16, 10).cast("long")
        return p.rlike("^(?:[0-9a-f]{4}|[1-9a-f][0-9a-f]{4,5})$") & (value >= 32) & (value <= 0x10FFFF) & ~value.between(0xD800, 0xDFFF)

    return F.octet_length(code).between(4, 128) & (F.size(parts) <= 16) & F.forall(parts, valid)


def opaque_id(value: Column) -> Column:
    return F.octet_length(value).between(1, 128) & value.rlike("^[A-Za-z0-9][A-Za-z0-9._:-]*$")


def canonical_version(value: Column) -> Column:
    """A whole number without sign or leading zeros that fits 64 bits."""
    return value.rlike("^(?:0|[1-9][0-9]*)$") & value.try_cast("bigint").isNotNull()


def name_present(query: Column, name: Column) -> Column:
    """Whether the last dotted part of a name is a word of the query, whatever its case."""
    return F.array_contains(words(query), F.lower(F.substring_index(name, ".", -1)))


def token_overlap(q: Column, d: Column) -> Column:
    """struct(hits, recall, jaccard, dice, cosine) of two token arrays as sets; 0 for empty ones."""
    a, b = F.array_distinct(q), F.array_distinct(d)
    hits, na, nb = F.size(F.array_intersect(a, b)), F.size(a), F.size(b)
    part = lambda x, y: x / F.greatest(y, F.lit(1))
    return F.struct(
        hits.alias("hits"), part(hits, na).alias("recall"), part(hits, na + nb - hits).alias("jaccard"), part(hits * 2, na + nb).alias("dice"),
        (hits / F.sqrt(F.greatest(na, F.lit(1)).cast("double") * F.greatest(nb, F.lit(1)))).alias("cosine"),
    )


def rule_clauses(text: Column) -> Column:
    """Clauses `if [not] a [op b] then x else y` of a `behavior-v1:` text, negation swapping the
    branches; null unless every clause has this form."""
    form = r"^\s*if (not )?(\w+)(?: (==|!=|<=|>=|<|>) (\w+))? then (.+?) else (.+?)\s*$"
    body = F.regexp_extract(text, r"(?s)^behavior-v1:(.*)$", 1)
    parts = F.filter(F.split(body, ";"), lambda c: F.trim(c) != "")

    def clause(c: Column) -> Column:
        g = lambda i: F.regexp_extract(c, form, i)
        negated = g(1) != ""
        return F.struct(
            g(2).alias("subject"), g(3).alias("operator"), g(4).alias("object"),
            F.when(negated, g(6)).otherwise(g(5)).alias("if_true"), F.when(negated, g(5)).otherwise(g(6)).alias("if_false"),
        )

    return F.when((F.size(parts) > 0) & F.forall(parts, lambda c: c.rlike(form)), F.transform(parts, clause))
