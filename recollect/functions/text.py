"""Column functions over text: all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recollect.settings import CHUNK_SIZE, METADATA_KEYS, ROLES

# Unicode white space and its complement, in a form RE2 and Java both read.
SPACE = r"[\s\x0B\x85\p{Z}]"
NON_SPACE = r"[^\s\x0B\x85\p{Z}]"


def word_count(text: Column) -> Column:
    """White-space separated words, counted without building an array."""
    return F.regexp_count(text, F.lit(NON_SPACE + "+"))


def substring_count(text: Column, needle: str) -> Column:
    """H9: non-overlapping occurrences of a constant, by the bytes that removing it saves."""
    gone = F.replace(text, F.lit(needle), F.lit(""))
    return (F.octet_length(text) - F.octet_length(gone)) / F.lit(float(len(needle.encode())))


def computed_once(**columns: Column) -> Column:
    """Columns that later expressions may use many times but that are evaluated once: Spark does
    not copy expressions across a generator, as it does across projections and filters."""
    return F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))


def strip_nul(text: Column) -> Column:
    """B19."""
    return F.replace(text, F.lit("\x00"), F.lit(""))


def clean_space(text: Column) -> Column:
    """Trim of Unicode white space at both ends."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def canonical_workspace(name: Column) -> Column:
    """H6: lower case, dashes and blanks to `_`, other signs dropped, `default` when empty."""
    lowered = F.translate(F.lower(clean_space(name)), "- ", "__")
    kept = F.btrim(F.regexp_replace(lowered, "[^a-z0-9_]", ""), F.lit("_"))
    return F.when(kept == "", "default").otherwise(kept)


def resolve_workspace(name: Column) -> Column:
    """H6: as `canonical_workspace`, but ids of UUID shape pass unchanged."""
    trimmed = clean_space(name)
    dashes = F.char_length(trimmed) - F.char_length(F.replace(trimmed, F.lit("-"), F.lit("")))
    return F.when((F.octet_length(trimmed) == 36) & (dashes == 4), trimmed).otherwise(
        canonical_workspace(name))


def valid_name(name: Column) -> Column:
    """Resource names."""
    return F.coalesce(name.rlike(r"^[a-zA-Z0-9_-]+$") & (F.octet_length(name) <= 512), F.lit(False))


def valid_role(role: Column) -> Column:
    """B20."""
    return F.coalesce(role.isin(*ROLES), F.lit(False))


def token_estimate(text: Column) -> Column:
    """Four bytes to a token, rounded up."""
    return F.floor((F.octet_length(text) + 3) / 4).cast("bigint")


def preview(text: Column, size: int) -> Column:
    """The first `size` bytes and an ellipsis; a split character becomes U+FFFD."""
    head = F.make_valid_utf8(F.substring(text.cast("binary"), 1, size).cast("string"))
    return F.when(F.octet_length(text) > size, F.concat(head, F.lit("…"))).otherwise(text)


def first_bytes(text: Column, size: int) -> Column:
    """A byte-bounded prefix without ellipsis."""
    return F.when(
        F.octet_length(text) > size,
        F.make_valid_utf8(F.substring(text.cast("binary"), 1, size).cast("string")),
    ).otherwise(text)


def content_hash(workspace: Column, session: Column, content: Column) -> Column:
    """H1."""
    return F.sha2(F.concat(workspace, F.lit("|"), session, F.lit("|"), content), 256)


def file_hash(content: Column) -> Column:
    """H2: the first eight bytes of the digest."""
    return F.left(F.sha2(content, 256), F.lit(16))


def code_message_id(path: Column) -> Column:
    """H3."""
    return F.left(F.concat(F.lit("codefile_"), F.sha2(path, 256)), F.lit(24))


def parent_doc_id(path: Column) -> Column:
    """H4."""
    return F.left(F.sha2(path, 256), F.lit(16))


def edge_id(prefix: str, *parts: Column) -> Column:
    """H5: a stable opaque id."""
    return F.concat(F.lit(prefix), F.left(F.sha2(F.concat_ws("\x1f", *parts), 256), F.lit(16)))


def csv_list(text: Column) -> Column:
    """Trimmed, non-empty items."""
    items = F.transform(F.split(text, ","), clean_space)
    return F.filter(items, lambda item: item != "")


def sanitize_agent(agent: Column, source: Column) -> Column:
    """H31."""
    kept = F.left(F.regexp_replace(F.lower(clean_space(agent)), "[^a-z0-9_-]", ""), F.lit(32))
    return F.coalesce(F.nullif(kept, F.lit("")), F.nullif(source, F.lit("")), F.lit("api"))


def session_file_name(session: Column) -> Column:
    """A path-safe name; names that are empty or too long become a digest."""
    safe = F.btrim(F.regexp_replace(session, "[^a-zA-Z0-9_-]", "_"), F.lit("_"))
    digest = F.concat(F.lit("session_"), F.left(F.sha2(session, 256), F.lit(16)))
    return F.when((safe == "") | (F.octet_length(safe) > 128), digest).otherwise(safe)


def vault_owner_dir(workspace: Column, owners: tuple[str, ...] = ()) -> Column:
    """Known owners have their own folder, all others share one."""
    name = F.regexp_replace(workspace, "^ws_", "")
    shared = F.concat(F.lit("_shared/knowledge/"), name)
    return F.when(name.isin(*owners), name).otherwise(shared) if owners else shared


def parse_time(text: Column) -> Column:
    """Null where the text is no RFC 3339 time."""
    shaped = text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$")
    return F.when(shaped, F.try_to_timestamp(text))


def to_number(text: Column) -> Column:
    """The leading number of a text, 0 where there is none."""
    lead = F.regexp_extract(text.cast("string"), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.coalesce(lead.try_cast("double"), F.lit(0.0))


def normal_tags(items: Column) -> Column:
    """Lower case, blanks to dashes, empties dropped."""
    return F.filter(
        F.transform(items, lambda t: F.replace(F.lower(clean_space(t)), F.lit(" "), F.lit("-"))),
        lambda t: t != "")


def keep_metadata(extra: Column) -> Column:
    """The allowed keys with a value."""
    return F.map_filter(extra, lambda k, v: k.isin(*METADATA_KEYS) & v.isNotNull() & (v != ""))


def day_key(ts: Column, zone: str) -> Column:
    """The local date of a UTC instant."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd")


def json_reply(reply: Column) -> Column:
    """A model's reply without its code fence."""
    return clean_space(F.regexp_replace(clean_space(reply), r"^```(json)?|```$", ""))


def json_field(reply: Column, name: str) -> Column:
    """A JSON field, or the first quoted value after its name when the JSON is broken."""
    body = json_reply(reply)
    loose = F.regexp_extract(body, rf'(?s)"{name}".*?:.*?"([^"]*)"', 1)
    return clean_space(
        F.coalesce(F.get_json_object(body, f"$.{name}"), F.nullif(loose, F.lit("")), F.lit("")))


def tool_call(reply: Column) -> Column:
    """`{"tool": …, "args": {…}}` inside a reply, null when there is none."""
    raw = F.regexp_extract(reply, r'(?s)(\{"tool".*\})', 1)
    return F.from_json(F.nullif(raw, F.lit("")), "tool STRING, args MAP<STRING,STRING>")


def _once(value: Column, body) -> Column:
    """`body` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def chunk_plain(text: Column, size: int = CHUNK_SIZE) -> Column:
    """Texts of up to `size` bytes stay whole; longer ones are cut into windows of `size`
    characters, each ended at its last blank when that blank lies past byte `size / 2` (the
    blank itself is dropped). Returns the pieces in order.

    A fold over the greatest possible number of windows: the shortest window that ends at a
    blank has more than `size / 2` bytes, hence at least `size / 8` characters.
    """
    def fold(total: Column) -> Column:
        steps = F.sequence(F.lit(0), F.floor(total / F.lit(size // 8 or 1)).cast("int"))

        def step(state: Column, _: Column) -> Column:
            pos = state["pos"]

            def grown(window: Column, head: Column) -> Column:
                last = pos + size > total
                at_blank = F.octet_length(head) > size // 2
                piece = F.when(last | ~at_blank, window).otherwise(head)
                jump = F.when(at_blank, F.char_length(head) + 1).otherwise(F.lit(size))
                return F.struct(
                    F.when(last, total + 1).otherwise(pos + jump).cast("int").alias("pos"),
                    F.array_append(state["parts"], piece).alias("parts"))

            cut = _once(F.substring(text, pos, F.lit(size)), lambda window: _once(
                F.regexp_extract(window, "(?s)^(.*) ", 1), lambda head: grown(window, head)))
            return F.when(pos > total, state).otherwise(cut)

        start = F.struct(F.lit(1).cast("int").alias("pos"),
                         F.array().cast("array<string>").alias("parts"))
        return F.aggregate(steps, start, step)["parts"]

    cut = _once(F.char_length(text), fold)
    return F.when(F.octet_length(text) <= size, F.array(text)).otherwise(cut)


def keyword_tags(path: Column, header: Column) -> Column:
    """The first twelve distinct words of path and header."""
    words = F.regexp_extract_all(F.concat(path, F.lit(" "), header), F.lit("[A-Za-z]{3,}"), 0)
    return F.slice(F.array_distinct(F.transform(words, F.lower)), 1, 12)


def extract_entities(text: Column, header: Column, known: list[str]) -> Column:
    """Known names found in the text, then title-case words of the header; at most 20."""
    found = F.filter(F.array(*[F.lit(k) for k in known]).cast("array<string>"),
                     lambda name: F.contains(text, name))
    titled = F.regexp_extract_all(header, F.lit(r"\b[A-Z][a-z]{2,}(?:[A-Z][a-z]+)*\b"), 0)
    return F.slice(F.array_distinct(F.concat(found, titled)), 1, 20)


def importance_for(path: Column) -> Column:
    """H21."""
    def has(*names: str) -> Column:
        return F.lit(False) if not names else path.rlike("|".join(names))

    return (F.when(has("longterm", "decisions"), 5).when(has("howto", "shared"), 4)
            .when(has("topics", "reference", "projects"), 3).otherwise(2))


def wikilinks(text: Column) -> Column:
    """Distinct link targets."""
    return F.array_distinct(F.transform(
        F.regexp_extract_all(text, F.lit(r"\[\[([^\]]+)\]\]"), 1), clean_space))


# The language of a file by its extension.
SYMBOL_LANGUAGES = {"go": "go", "py": "python", "ts": "ts", "tsx": "ts", "js": "ts", "jsx": "ts"}
TEXT_LANGUAGES = {"sql": "sql", "yml": "yaml", "yaml": "yaml", "md": "markdown", "sh": "shell",
                  "json": "json"}


def language_for(path: Column) -> Column:
    """Empty for files that are not indexed."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    pairs = [F.lit(x) for kv in {**SYMBOL_LANGUAGES, **TEXT_LANGUAGES}.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), ext), F.lit(""))


def code_tokens(source: Column) -> Column:
    """Distinct lower-case parts of the words of a source text, and each word joined."""
    words = F.regexp_extract_all(source, F.lit("[A-Za-z0-9_$]+"), 0)
    parts = F.flatten(F.transform(words, lambda w: F.concat(
        F.regexp_extract_all(w, F.lit(".+?(?:(?<=[a-z0-9])(?=[A-Z])|$)"), 0), F.array(F.replace(w, F.lit("_"), F.lit(""))))))
    return F.array_distinct(F.transform(
        F.filter(parts, lambda t: F.char_length(t) >= 3), F.lower))


def chunk_title(chunk_type: Column, entities: Column) -> Column:
    """`entities` is a list of names."""
    names = F.size(entities)
    listed = F.concat_ws(", ", F.slice(entities, 1, 3))
    more = F.when(names > 3, F.concat(F.lit(" (+"), (names - 3).cast("string"), F.lit(")"))).otherwise("")
    return (F.when(chunk_type == "file_overview", "Overview")
            .when((chunk_type == "text") & (names == 0), "Content")
            .when(names == 0, "Symbols")
            .otherwise(F.concat(listed, more)))


def classify_request(method: Column, path: Column) -> Column:
    """The usage action of a request, null for telemetry and plain reads.

    The path rules are fixed values of the HTTP surface.
    """
    telemetry = path.isin(
        "/api/v1/health", "/health", "/", "/api/v1/metrics", "/api/v1/usage/daily",
        "/api/v1/messages/analytics", "/api/v1/messages/pending")
    retrieval = (
        path.startswith("/api/v1/messages/search")
        | (path.endswith("/search") & path.contains("/workspaces/"))
        | path.rlike("/(conclusions/(query|trace|stale|brief)|representations"
                     "|messages/(grep|temporal)|code/(symbols|callers))$")
        | (path.contains("/context") & (method == "GET")))
    post = method == "POST"
    return (F.when(telemetry, None)
            .when(retrieval, "search")
            .when(post & path.isin("/api/v1/messages", "/api/v1/messages/batch"), "store")
            .when(post & (path == "/api/v1/messages/upload"), "upload")
            .when(post & path.endswith("/brain/ask"), "ask")
            .when(path.contains("/chat") & method.isin("POST", "GET"), "chat")
            .when(path.startswith("/api/v1/code/"), "code")
            .when(method.isin("POST", "PUT", "PATCH", "DELETE"), "other"))
