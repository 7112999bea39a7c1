"""Building blocks of the check SQL: the fixtures once more, in plain SQL."""

from __future__ import annotations

from pageloom.plans.fixtures import (
    COMMENTS_PER_PAGE,
    FEED_IDS,
    GERMAN_MONTHS,
    IMAGE_SUFFIXES,
    POLISH_MONTHS,
    SITEMAP_ENTRIES,
)

HOST = "lower(regexp_extract(url, '^https?://([^/?#]+)', 1))"
BLOG = "lower(regexp_extract(url, '^(https?://[^/?#]+)', 1))"

# The tags a content slice of `pages` can hold besides the kept ones.
PAGES = f"""pg AS (
  SELECT page_id, url, html, {BLOG} AS blog,
    trim(regexp_extract(html, '<title>([^>^<]*)</title>', 1)) AS raw_title,
    trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      regexp_extract(html, '(?s)(<article>.*</article>)', 1),
      '\\n', '', 'g'), '</?(article|h1)>', '', 'g'),
      '[ \\t\\r\\f]+', ' ', 'g'), '</b>\\s*<b>', '', 'g')) AS content
  FROM pages
), pt AS (
  SELECT *, replace(replace(replace(regexp_replace(raw_title, '&amp;?', '&', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"') AS title FROM pg
)"""

ESCAPED = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _months(names: str) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names.split(",")) + "]"


POSTS = f"""p0 AS (
  SELECT doc_id, text, lang, source, 'https://' || source || '.blogspot.com' AS blog,
    2010 + doc_id % 10 AS y, 1 + (doc_id // 3) % 12 AS m, 1 + doc_id % 28 AS d,
    CASE doc_id % 4 WHEN 1 THEN 'pl' WHEN 3 THEN 'de' ELSE 'en' END AS post_lang,
    trim(split_part(text, chr(10), 1)) AS first_line
  FROM documents
), posts AS (
  SELECT *, doc_id AS seq,
    blog || '/' || y || '/' || lpad(m::VARCHAR, 2, '0') || '/p' || doc_id || '.html' AS url,
    CASE
      WHEN doc_id % 10 = 9 THEN NULL
      WHEN doc_id % 4 = 1 THEN 'wtorek, ' || d || ' ' || {_months(POLISH_MONTHS)}[m] || ' ' || y
      WHEN doc_id % 4 = 3 THEN d || '. ' || {_months(GERMAN_MONTHS)}[m] || ' ' || y
      ELSE y || '-' || lpad(m::VARCHAR, 2, '0') || '-' || lpad(d::VARCHAR, 2, '0')
        || 'T08:30:00+02:00' END AS date_text,
    CASE
      WHEN doc_id % 10 = 9 THEN make_timestamp(y, m, 1, 0, 0, 0)
      WHEN doc_id % 2 = 1 THEN make_timestamp(y, m, d, 0, 0, 0)
      ELSE make_timestamp(y, m, d, 6, 30, 0) END AS date,
    CASE WHEN doc_id % 7 = 0 THEN '' ELSE source || '|' || lang END AS tags,
    CASE WHEN doc_id % 3 = 0 THEN blog || '/img' || (doc_id % 50) || '.jpg' END AS image_url
  FROM p0
)"""

TABLE_OPEN = (
    '<table align="center" cellpadding="0" cellspacing="0" class="tr-caption-container"'
    ' style="margin-left: auto; margin-right: auto; text-align: center; background: #FFF;'
    'box-shadow: 1px 1px 5px rgba(0, 0, 0, 0.5); padding: 8px;"><tbody>'
    '<tr><td style="text-align: center;"><img border="0" src="images/'
)
TABLE_MID = '" /></td></tr><tr><td class="tr-caption" style="text-align: center;">'
TABLE_END = "</td></tr></tbody></table>"
RESIZED = "_600_800_40_bw.jpg"

ARTICLES = f"""{POSTS}, arts AS (
  SELECT *,
    CASE WHEN doc_id % 25 = 7 THEN strftime(date, '%A, %d %B %Y, %H:%M') ELSE first_line END AS title,
    trim(regexp_replace('<p>' || replace({ESCAPED.format("text")}, chr(10), '') ||
      CASE doc_id % 3
        WHEN 0 THEN '{TABLE_OPEN}' || md5(image_url) || '{RESIZED}{TABLE_MID}pic '
          || (doc_id % 50) || '{TABLE_END}'
        WHEN 1 THEN '<img src="/pic.svg">' ELSE '' END,
      '[ \\t\\r\\f]+', ' ', 'g')) AS content
  FROM posts
)"""

TURNS = f"""turns AS (
  SELECT conv_id, turn, role, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS body,
    conv_id || '-' || (turn // {COMMENTS_PER_PAGE}) AS page
  FROM conversations
), grouped AS (
  SELECT *, coalesce(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (
      PARTITION BY page ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g
  FROM turns
), roles AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY page, g ORDER BY turn) = 1
      THEN 'author' ELSE 'body' END AS role_of
  FROM grouped
)"""

REFS = f"""{POSTS}, r0 AS (
  SELECT blog, url AS article_url, doc_id AS pos, 'pic ' || (doc_id % 50) AS alt,
    doc_id * 37 % 300 AS w, doc_id * 53 % 300 AS h,
    CASE
      WHEN doc_id % 11 = 0 THEN 'https://zblogowani.pl/button' || (doc_id % 5) || '.png'
      WHEN doc_id % 13 = 0 THEN 'https://resources.blogblog.com/img/icon18_edit.gif'
      ELSE CASE doc_id % 4 WHEN 0 THEN 'https://cdn.example.com/a/' WHEN 1 THEN '/up/'
          WHEN 2 THEN '//cdn.example.com/b/' ELSE 'img/' END
        || 'img' || (doc_id % 50) || {_months(IMAGE_SUFFIXES)}[doc_id % 9 + 1]
        || CASE WHEN doc_id % 5 = 0 THEN '?w=1' ELSE '' END END AS src
  FROM posts
), refs AS (
  SELECT *, md5(url) AS hash FROM (
    SELECT *, CASE
        WHEN src LIKE 'http%' THEN src
        WHEN src LIKE '//%' THEN 'https:' || src
        WHEN src LIKE '/%' THEN blog || src
        ELSE blog || '/' || src END AS url
    FROM r0)
), typed AS (
  SELECT *, lower(regexp_extract(url, '(\\.[a-zA-Z]+)(\\?w=1)?$', 1)) AS ext FROM refs
)"""

EVENTS = """ev AS (
  SELECT 'user' || user_id AS blog, event_id AS seq,
    CASE WHEN event_id % 7 <> 0 THEN ts END AS date
  FROM events
)"""

LISTED = f"""listed AS (
  SELECT {BLOG} AS blog, page_id, url, page_id // {SITEMAP_ENTRIES} AS part,
    row_number() OVER (PARTITION BY {BLOG}, page_id // {SITEMAP_ENTRIES} ORDER BY page_id) AS pos,
    CASE WHEN page_id % 2 = 0 THEN '2024-01-01T00:00:00+00:00' ELSE '' END AS lastmod
  FROM pages
)"""

FEED_PARTS = f"doc_id // {FEED_IDS}"

SUPPORTED = "('.jpeg', '.jpg', '.png', '.bmp', '.gif', '.webp', '.heic')"


def stamp(c: str) -> str:
    return f"coalesce(strftime({c}, '%Y-%m-%d %H:%M:%S'), '')"
