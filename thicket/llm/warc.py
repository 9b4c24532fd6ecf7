"""Derivatives of WARC responses: linked metadata records and plain-text conversion records.

``responses`` wraps fetched pages as response records; ``derive`` makes from
each a metadata record (title, language, outgoing links, the response's own
headers and digests) and a conversion record (its text). Both refer to the
response by its id and carry its target and payload digest; all ids and digests
follow from the content, so a run repeated gives the same records.

Null html counts as an empty page, a null url as an empty one; null ids pass
through. Repeated rows give repeated records. Other columns are left out.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DATE = "2026-01-01T00:00:00Z"
#: What a conversion drops, and what it breaks lines at. A tag begins with a letter, so a bare "<" stays.
DROPPED = r"(?is)<script(\s[^>]*)?>.*?</script\s*>|<style(\s[^>]*)?>.*?</style\s*>|<!--.*?-->|<head(\s[^>]*)?>.*?</head\s*>|<nav(\s[^>]*)?>.*?</nav\s*>|<footer(\s[^>]*)?>.*?</footer\s*>"
BREAKS = r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|td|table|article|section|blockquote|pre)(\s[^>]*)?/?>"
TAGS = r"</?[A-Za-z][^>]*>|<[!?][^>]*>"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
LANGUAGE = r"""(?i)<html\s[^>]*?lang\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
QUOTES = r"""^["']|["']$"""
TITLE = r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>"
#: A character reference: a decimal or hexadecimal number, or a name.
REFERENCE = r"&(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);"
#: The commonest names, tried before the full table of HTML.
COMMON = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "nbsp": " ", "copy": "©", "middot": "·", "#39": "'"}
NAMES = {name[:-1]: text for name, text in html5.items() if name.endswith(";")} | {"nbsp": " "}


def _urn(*parts) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _digest(text) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """page_id, record_id, target_uri, date, http_headers, payload, payload_digest of a response record for each page."""
    own = pages.select("page_id", F.coalesce("url", F.lit("")).alias("target_uri"), F.lit(date).alias("date"), F.coalesce("html", F.lit("")).alias("payload"))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload"))
    return own.withColumn("payload_digest", _digest("payload")).withColumns({"record_id": _urn(F.lit("response"), "target_uri", "payload_digest"), "http_headers": headers})


def _resolved(text: Column) -> Column:
    """The text with its character references resolved, each once; unknown ones stay."""
    hits = F.regexp_extract_all(text, F.lit(REFERENCE), 1)
    gaps = F.split(text, REFERENCE, -1)
    table = F.from_json(F.lit(json.dumps(NAMES)), "map<string,string>")

    def one(name: Column) -> Column:
        code = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(F.substring(name, 2, 7)).cast("int")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        utf32 = F.unhex(F.lpad(F.hex(code), 8, "0"))
        number = F.when(valid, F.decode(utf32, "UTF-32"))
        known = F.when(name.startswith("#") & (name != "#39"), number)
        for k, v in COMMON.items():
            known = known.when(name == k, F.lit(v))
        return F.coalesce(known.otherwise(F.get(F.transform(F.array(name), lambda n: F.try_element_at(table, n)), F.lit(0))), F.concat(F.lit("&"), name, F.lit(";")))

    whole = F.concat(F.array_join(F.flatten(F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.array(g, one(h)))), ""), F.element_at(gaps, -1))
    return F.when(text.contains("&"), F.when(F.size(hits) > 0, whole).otherwise(text)).otherwise(text)


def plain_text(html: Column) -> Column:
    """The page's text: no scripts, styles, comments, head, navigation or footer; a line for each block."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, DROPPED, ""), BREAKS, "\n"), TAGS, "")
    return F.trim(F.regexp_replace(F.regexp_replace(_resolved(text), r"[ \t\r]+", " "), r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def derive(records: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each response, with their digests and lengths."""
    title = F.trim(F.regexp_replace(_resolved(F.regexp_extract("payload", TITLE, 1)), r"\s+", " "))
    language = F.regexp_replace(F.regexp_extract("payload", LANGUAGE, 1), QUOTES, "")
    found = F.regexp_extract_all("payload", F.lit(LINK), 1)
    links = F.array_join(F.transform(found, lambda x: F.concat(F.lit("\r\noutlink: "), _resolved(F.regexp_replace(x, QUOTES, "")))), "")
    fields = F.concat(F.lit("title: "), title, F.lit("\r\nlanguage: "), language, F.lit("\r\nsource-payload-digest: "), "payload_digest", F.lit("\r\nsource-http-headers: "), F.replace("http_headers", F.lit("\r\n"), F.lit("; ")), links)
    kinds = F.explode(F.array(*[F.struct(F.lit(kind).alias("record_type"), F.lit(mime).alias("content_type"), block.alias("block")) for kind, mime, block in (("metadata", "application/warc-fields", fields), ("conversion", "text/plain", plain_text(F.col("payload"))))]))
    made = records.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", "payload_digest", kinds.alias("r")).select("page_id", "r.*", "refers_to", "target_uri", "date", F.col("payload_digest").alias("source_digest"))
    return made.withColumns({"block_digest": _digest("block"), "n_bytes": F.octet_length("block").cast("long")}).withColumn("record_id", _urn("record_type", "refers_to", "block_digest"))


def serialised(records: DataFrame) -> Column:
    """A derived record as it stands in a WARC file."""
    lines = [F.lit("WARC/1.1"), *(F.concat(F.lit(f"{name}: "), value) for name, value in (("WARC-Type", F.col("record_type")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Refers-To", F.col("refers_to")), ("WARC-Target-URI", F.col("target_uri")), ("WARC-Date", F.col("date")), ("WARC-Block-Digest", F.col("block_digest")), ("WARC-Source-Payload-Digest", F.col("source_digest")), ("Content-Type", F.col("content_type")), ("Content-Length", F.col("n_bytes").cast("string"))))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), F.col("block"), F.lit("\r\n\r\n"))


def _sql_urn(parts: str) -> str:
    h = f"md5({parts})"
    return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_resolved(text: str) -> str:
    """For the checking engine: the references that the test pages hold, the ampersand last."""
    for name in sorted(COMMON, key=lambda n: n == "amp"):
        text = f"replace({text}, '&{name};', {_q(COMMON[name])})"
    return text


def _sql_text() -> str:
    text = f"regexp_replace(regexp_replace(regexp_replace(payload, {_q(DROPPED)}, '', 'g'), {_q(BREAKS)}, chr(10), 'g'), {_q(TAGS)}, '', 'g')"
    return f"trim(regexp_replace(regexp_replace({_sql_resolved(text)}, '[ \\t\\r]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10))"


ORACLE = f"""
WITH r AS (
  SELECT page_id, coalesce(url, '') AS target_uri, '{DATE}' AS date, coalesce(html, '') AS payload, 'sha256:' || sha256(coalesce(html, '')) AS source_digest FROM pages),
s AS (SELECT *, {_sql_urn("'response|' || target_uri || '|' || source_digest")} AS refers_to,
  'HTTP/1.1 200 OK; Content-Type: text/html; charset=utf-8; Content-Length: ' || strlen(payload) AS headers FROM r),
d AS (
  SELECT page_id, refers_to, target_uri, date, source_digest, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
    'title: ' || trim(regexp_replace({_sql_resolved(f"regexp_extract(payload, {_q(TITLE)}, 1)")}, '\\s+', ' ', 'g')) || chr(13) || chr(10) ||
    'language: ' || regexp_replace(regexp_extract(payload, {_q(LANGUAGE)}, 1), {_q(QUOTES)}, '', 'g') || chr(13) || chr(10) || 'source-payload-digest: ' || source_digest || chr(13) || chr(10) ||
    'source-http-headers: ' || headers || coalesce(array_to_string(list_transform(regexp_extract_all(payload, {_q(LINK)}, 1), lambda x: chr(13) || chr(10) || 'outlink: ' || {_sql_resolved(f"regexp_replace(x, {_q(QUOTES)}, '', 'g')")}), ''), '') AS block FROM s
  UNION ALL
  SELECT page_id, refers_to, target_uri, date, source_digest, 'conversion', 'text/plain', {_sql_text()} FROM s)
SELECT page_id, record_type, content_type, block, refers_to, target_uri, date, source_digest, 'sha256:' || sha256(block) AS block_digest, CAST(strlen(block) AS BIGINT) AS n_bytes,
  {_sql_urn("record_type || '|' || refers_to || '|' || 'sha256:' || sha256(block)")} AS record_id FROM d
"""
