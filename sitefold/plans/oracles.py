"""The same queries in DuckDB SQL, written from the tables without the library."""

from __future__ import annotations

from sitefold.plans.stand_ins import IDS_PER_PAGE, RUN_TIME, SEGMENTS

# Fixed values, written out here so that a wrong entry of the library shows.
TAG_REPLACEMENTS = [
    ("<h1>", "# "), ("</h1>", "\n\n"), ("<h2>", "## "), ("</h2>", "\n\n"), ("<h3>", "### "), ("</h3>", "\n\n"),
    ("<h4>", "#### "), ("</h4>", "\n\n"), ("<h5>", "##### "), ("</h5>", "\n\n"), ("<h6>", "###### "), ("</h6>", "\n\n"),
    ("<strong>", "**"), ("</strong>", "**"), ("<b>", "**"), ("</b>", "**"), ("<em>", "*"), ("</em>", "*"), ("<i>", "*"), ("</i>", "*"),
    ("<p>", ""), ("</p>", "\n\n"), ("<br>", "\n"), ("<br/>", "\n"), ("<br />", "\n"), ("<ul>", ""), ("</ul>", "\n"), ("<ol>", ""), ("</ol>", "\n"),
    ("<li>", "- "), ("</li>", "\n"), ("<code>", "`"), ("</code>", "`"), ("<pre>", "```\n"), ("</pre>", "\n```"),
]
WHITE_SPACE = (
    "\t\n\v\f\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
MIME_EXTENSIONS = {
    "image/jpeg": ".jpg", "image/jpg": ".jpg", "image/png": ".png", "image/gif": ".gif", "image/webp": ".webp", "image/svg+xml": ".svg", "image/bmp": ".bmp",
    "image/tiff": ".tiff", "video/mp4": ".mp4", "video/avi": ".avi", "video/mov": ".mov", "video/wmv": ".wmv", "video/flv": ".flv", "video/webm": ".webm",
    "audio/mp3": ".mp3", "audio/wav": ".wav", "audio/ogg": ".ogg", "application/pdf": ".pdf", "text/plain": ".txt", "application/zip": ".zip",
}
DEFAULT_EXTENSION = ".bin"


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def markdown(html: str) -> str:
    sql = html
    for old, new in TAG_REPLACEMENTS:
        sql = f"replace({sql}, {lit(old)}, {lit(new)})"
    return f"trim(replace({sql}, {lit(chr(10) * 3)}, {lit(chr(10) * 2)}), {lit(WHITE_SPACE)})"


def folder(name: str) -> str:
    cleaned = f"trim(regexp_replace(translate({name}, '/\\:*?\"<>| ', '----------'), '-+', '-', 'g'), '-')"
    return f"coalesce(nullif({cleaned}, ''), 'category')"


def domain(name: str) -> str:
    """Names whose last part has no dot of its own trim as a whole; the rest before the last dot."""
    cleaned = f"regexp_replace(translate({name}, '/\\:*?\"<>| ', '----------'), '-+', '-', 'g')"
    stem = f"trim(regexp_extract({cleaned}, '^(.+)\\.[^.]*$', 1), '-')"
    dotted = f"{stem} || '.' || regexp_extract({cleaned}, '\\.([^.]*)$', 1)"
    return f"trim(CASE WHEN regexp_matches({cleaned}, '^.+\\.[^.]*$') THEN {dotted} ELSE {cleaned} END, '-')"


def link_folder(link: str) -> str:
    path = f"trim(url_decode(replace(regexp_extract({link}, '^[a-z]+://[^/?#]*([^?#]*)', 1), '+', '%2B')), '/')"
    parts = f"string_split({path}, '/')"
    kept = f"list_filter({parts}[1:len({parts}) - 1], lambda s: NOT regexp_matches(s, '^[0-9]+$') AND s NOT IN ('blog', 'posts', 'archives'))"
    names = f"list_filter(list_transform({kept}, lambda s: {folder('s')}), lambda s: s <> 'category')"
    dated = f"len({parts}) >= 3 AND len(list_filter({parts}[1:3], lambda s: regexp_matches(s, '^[0-9]+$'))) = 3"
    return f"CASE WHEN {dated} THEN '' ELSE coalesce(array_to_string({names}, '/'), '') END"


def file_name(slug: str, key: str) -> str:
    return f"translate(CASE WHEN {slug} = '' THEN 'post-' || {key} ELSE {slug} END, '/\\:', '---') || '.md'"


PAGE_SLUG = "regexp_extract(url, '^[a-z]+://[^?#]*/([^/?#]*)', 1)"
HOST = "split_part(url, '/', 3)"

ORDER_LINK = """CASE WHEN o_orderstatus = 'F' THEN 'https://shop.example.com' || strftime(o_orderdate, '/%Y/%m/%d') || '/order-' || o_orderkey
  WHEN o_orderpriority IN ('1-URGENT', '4-NOT SPECIFIED') THEN 'https://shop.example.com/blog/' || o_orderpriority || strftime(o_orderdate, '/%Y')
    || '/a%2Fb+c/order-' || o_orderkey || '/?x=/y/z#top'
  ELSE 'https://shop.example.com/order-' || o_orderkey END"""

ORDER_POSTS = f"""order_posts AS (
  SELECT 'site-' || c_nationkey AS site, o_orderkey AS id, 'post' AS content_type,
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS date, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+02:00' AS modified,
    CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE 'order:' || o_orderkey END AS slug,
    CASE o_orderstatus WHEN 'F' THEN 'publish' WHEN 'O' THEN 'draft' ELSE 'private' END AS status,
    {ORDER_LINK} AS link, 'Order ' || o_orderkey || ' "' || o_orderpriority || '"' AS title,
    '<h2>Order ' || o_orderkey || '</h2><p>Status <b>' || o_orderstatus || '</b></p><p>Priority ' || o_orderpriority || '</p>' || chr(10) AS content,
    CASE WHEN o_orderstatus = 'F' THEN '<p><em>' || o_orderpriority || '</em></p>' ELSE '' END AS excerpt,
    o_custkey AS author, CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey ELSE 0 END AS featured_media,
    CASE WHEN o_orderstatus = 'P' THEN []::BIGINT[] ELSE [o_custkey + 100001, 1] END AS categories,
    [year(o_orderdate)]::BIGINT[] AS tags, o_totalprice > 499000 AND o_orderstatus = 'F' AS broken
  FROM orders JOIN customer ON c_custkey = o_custkey)"""

PAGE_POSTS = f"""page_posts AS (
  SELECT {HOST} AS site, page_id AS id, strftime(TIMESTAMP '2024-01-01' + to_hours(page_id), '%Y-%m-%dT%H:%M:%S') AS date, 'unknown' AS modified,
    {PAGE_SLUG} AS slug, 'publish' AS status, url AS link, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, html AS content,
    CASE WHEN url LIKE 'https:%' THEN '<p>' || regexp_extract(html, '<title>([^<]*)</title>', 1) || '</p>' ELSE '' END AS excerpt,
    0 AS author, 0 AS featured_media, []::BIGINT[] AS categories, []::BIGINT[] AS tags
  FROM pages)"""

_SEGMENT_LIST = "[" + ", ".join(lit(s) for s in SEGMENTS) + "]"
CATEGORIES = f"""category_nodes AS (
  SELECT 'site-' || n_nationkey AS site, n_regionkey + 1 AS id, 0 AS parent, lower(r_name) AS slug FROM nation JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT 'site-' || n_nationkey, n_nationkey + 101, n_regionkey + 1, n_name FROM nation JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT DISTINCT 'site-' || c_nationkey, list_position({_SEGMENT_LIST}, c_mktsegment) + 1000, c_nationkey + 101, c_mktsegment FROM customer
  UNION ALL SELECT 'site-' || c_nationkey, c_custkey + 100001, list_position({_SEGMENT_LIST}, c_mktsegment) + 1000, replace(c_name, '#', ': ') FROM customer)"""

CATEGORY_PATHS = f"""category_paths AS (
  SELECT n.site, n.id, 1 AS depth, {folder('n.slug')} AS path FROM category_nodes n
    LEFT JOIN category_nodes p ON p.site = n.site AND p.id = n.parent WHERE p.id IS NULL
  UNION ALL
  SELECT n.site, n.id, p.depth + 1, p.path || '/' || {folder('n.slug')}
    FROM category_nodes n JOIN category_paths p ON p.site = n.site AND p.id = n.parent)"""


def printed(time: str) -> str:
    """Times of the stand-ins: with no offset, with +02:00, or unreadable."""
    return f"CASE WHEN {time} = 'unknown' THEN '{RUN_TIME}' WHEN {time} LIKE '%+%' THEN {time} ELSE {time} || 'Z' END"


def yaml(value: str) -> str:
    return f"replace(replace(replace({value}, '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r')"


def id_list(name: str) -> str:
    return f"CASE WHEN len({name}) > 0 THEN '{name}:' || array_to_string(list_transform({name}, lambda i: chr(10) || '  - ' || i), '') END"


def front_matter(content_type: str) -> str:
    return f"""concat_ws(chr(10), '---', 'id: ' || id, 'title: "' || {yaml('title')} || '"', 'slug: "' || slug || '"',
      'date: ' || {printed('date')}, 'modified: ' || {printed('modified')}, 'status: "' || status || '"', 'type: "{content_type}"',
      'link: "' || link || '"', CASE WHEN author > 0 THEN 'author: ' || author END,
      CASE WHEN featured_media > 0 THEN 'featured_media: ' || featured_media END, {id_list('categories')}, {id_list('tags')}, '---')"""


def document(content_type: str) -> str:
    nl = "chr(10) || chr(10)"
    excerpt = f"CASE WHEN excerpt <> '' THEN '## Excerpt' || {nl} || {markdown('excerpt')} || {nl} ELSE '' END"
    return f"{front_matter(content_type)} || {nl} || '# ' || title || {nl} || {excerpt} || '## Content' || {nl} || {markdown('content')}"


def last_write(key: str) -> str:
    return f"QUALIFY row_number() OVER (PARTITION BY site, {key} ORDER BY id DESC) = 1"


LOOKUPS = """lookups AS (
  SELECT 'posts' AS content_type, o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 200 WHEN 'O' THEN 404 ELSE 500 END AS status,
    o_orderpriority <> '5-LOW' AS readable, o_orderpriority AS slug FROM orders
  UNION ALL SELECT 'pages', c_custkey, CASE WHEN c_acctbal > 0 THEN 200 ELSE 404 END, true, c_mktsegment FROM customer
  UNION ALL SELECT 'media', doc_id, 200, true, source FROM documents)"""
LISTED = """listed AS (
  SELECT DISTINCT 'posts' AS content_type, l_orderkey AS id FROM lineitem
  UNION ALL SELECT DISTINCT 'pages', user_id FROM events UNION ALL SELECT DISTINCT 'media', doc_id FROM labels)"""
DISCOVERED = """discovered AS (
  SELECT content_type, id, slug FROM lookups l WHERE status = 200 AND readable AND id >= 1
    AND NOT EXISTS (SELECT 1 FROM listed k WHERE k.content_type = l.content_type AND k.id = l.id))"""

MIME = "CASE WHEN url LIKE '%/en/%' THEN '.png' WHEN url LIKE '%/fr/%' THEN '.pdf' ELSE '.bin' END"
PAGE_MEDIA = f"""page_media AS (
  SELECT {HOST} AS site, page_id AS id, regexp_extract(url, '^([^?#]*[^?#/])', 1) AS bare,
    CASE WHEN url LIKE '%#top' THEN regexp_extract(url, '^([a-z]+://[^/]*/)', 1) WHEN url LIKE '%/' THEN '' ELSE url END AS source_url,
    page_id || '_' || CASE WHEN url LIKE '%#top' THEN 'media_' || page_id || {MIME} ELSE regexp_extract(url, '/([^/?#]+)(?:[?#].*)?$', 1) END AS file
  FROM pages)"""
ATTEMPTS = f"""attempts AS (
  SELECT {HOST} AS site, user_id AS media_id, minute(ts) // 10 + 1 AS attempt,
    CASE WHEN event_type = 'purchase' AND value > 100 THEN 200 WHEN event_type = 'error' THEN 500 ELSE 404 END AS status
  FROM events JOIN pages ON page_id = user_id)"""
OUTCOMES = """outcomes AS (
  SELECT site, media_id, count(*) AS attempts, bool_or(status = 200) AS downloaded FROM attempts WHERE attempt <= 4 GROUP BY ALL)"""
PRESENT = f"""present AS (
  SELECT DISTINCT {HOST} AS site, page_id || '_' || regexp_extract(url, '/([^/?#]+)/?(?:[?#].*)?$', 1) AS file FROM pages WHERE url LIKE 'http:%')"""
MANIFEST = """manifest AS (
  SELECT m.site, m.id AS media_id, CASE WHEN source_url = '' THEN NULL ELSE '/export/media/' || m.file END AS local_path,
    CASE WHEN source_url = '' THEN 'no_url' WHEN p.file IS NOT NULL THEN 'present' WHEN o.downloaded THEN 'downloaded' ELSE 'failed' END AS status
  FROM page_media m LEFT JOIN present p ON p.site = m.site AND p.file = m.file AND source_url <> ''
    LEFT JOIN outcomes o ON o.site = m.site AND o.media_id = m.id)"""

EVENT_LISTING = """event_listing AS (
  SELECT 'user-' || user_id AS site, event_type AS endpoint, event_id::INT AS page,
    CASE WHEN value > 190 THEN 400 WHEN value > 150 THEN 500 ELSE 200 END AS status,
    CASE WHEN value < 1 THEN '[]' WHEN value < 2 THEN '[{' WHEN value < 3 THEN '[{"id":' || event_id || '},7,{"id":' || event_id || '}]'
      WHEN value < 4 THEN '[{"id":' || event_id || '},null]' ELSE '[{"id":' || event_id || '}]' END AS body, value FROM events)"""
EVENT_CUTS = """cuts AS (
  SELECT site, endpoint, min(page) FILTER (value > 190 OR value < 1) AS stop_page,
    min(page) FILTER ((value > 150 AND value <= 190) OR (value >= 1 AND value < 3)) AS error_page, max(page) AS last_page
  FROM event_listing GROUP BY ALL),
  ends AS (SELECT site, endpoint, stop_page, error_page, coalesce(stop_page, last_page + 1) AS end_page,
    error_page IS NOT NULL AND (stop_page IS NULL OR error_page < stop_page) AS failed FROM cuts)"""


def listed_page(key: str) -> str:
    return f"({key} // {IDS_PER_PAGE} + 1)"


SITE_INFO = """site_info AS (
  SELECT *, CASE WHEN c_acctbal > 5000 THEN c_acctbal <= 9000 ELSE c_acctbal >= 1000 END AS readable, c_acctbal > 5000 AS own FROM customer)"""

SITE_COLUMNS = """'c-' || c_custkey AS site, CASE WHEN NOT readable THEN 'WordPress Site' WHEN own THEN '' ELSE c_name END AS name,
  CASE WHEN readable AND NOT own THEN c_mktsegment ELSE '' END AS description,
  CASE WHEN NOT readable THEN 'https://given/' || c_custkey WHEN own THEN 'https://s/' || c_custkey ELSE '' END AS url,
  CASE WHEN readable AND NOT own THEN 'https://h/' || c_custkey ELSE '' END AS home_url, '' AS admin_email, '' AS timezone,
  '' AS date_format, '' AS time_format, CASE WHEN readable AND own THEN c_nationkey ELSE 0 END::BIGINT AS start_of_week,
  CASE WHEN readable AND own THEN 'en' ELSE '' END AS language"""

LINKED_MEDIA = f"""linked_media AS (
  SELECT site, href, min(page_id * 1000000 + pos) AS id FROM (
    SELECT {HOST} AS site, page_id, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) - 1 AS pos
    FROM (SELECT url, page_id, regexp_extract_all(html, 'href="(/[^"]*)"', 1) AS hrefs FROM pages)) GROUP BY ALL)"""

_LOCAL = "'media/' || {0} || '_' || translate({1}[2:], '\\:*?\"<>|', '________')"
LINKED_URLS = f"""{LINKED_MEDIA}, linked_ends AS (SELECT site, min(id) AS first_id, max(id) AS last_id, arg_min(href, id) AS first_href FROM linked_media GROUP BY site),
  linked_urls AS (SELECT site, id, 0 AS k, 'https://' || site || href AS u, {_LOCAL.format('id', 'href')} AS p FROM linked_media
    UNION ALL SELECT site, id, 1, 'https://' || site || href || '-150x150.png', {_LOCAL.format('id', 'href')} || '-150x150.png' FROM linked_media
    UNION ALL SELECT site, id, 2, '/wide' || href || '.png', {_LOCAL.format('id', 'href')} || '.png' FROM linked_media
    UNION ALL SELECT site, last_id, 3, {_LOCAL.format('first_id', 'first_href')}, 'media/' || last_id || '_' || ({_LOCAL.format('first_id', 'first_href')})[7:] FROM linked_ends WHERE last_id > first_id)"""
LINKED_POSTS = f"""linked_posts AS (SELECT site, content_type, id, replace(html, 'href="/', 'href="https://' || site || '/')
      || CASE WHEN href <> '' THEN '<img src="https://' || site || href || '-150x150.png"><img src="/wide' || href || '.png">' ELSE '' END AS content,
    CASE WHEN secure THEN '<p>' || title || '</p>' || CASE WHEN href <> '' THEN '<a href="https://' || site || href || '">more</a>' ELSE '' END ELSE '' END AS excerpt
  FROM (SELECT {HOST} AS site, CASE WHEN page_id % 3 = 0 THEN 'page' ELSE 'post' END AS content_type, page_id AS id, html, regexp_extract(html, 'href="(/[^"]*)"', 1) AS href,
    url LIKE 'https:%' AS secure, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages))"""


def _swapped(name: str, found: bool) -> str:
    """A text of every post with its site's URLs replaced one after the other; ``found``: only those that it holds at first."""
    held = f" AND contains(p.{name}, u.u)" if found else ""
    return f"""swapped_{name} AS (SELECT p.site, p.id, list_reduce(list_prepend({{'c': any_value(p.{name}), 'u': '', 'p': ''}}, list({{'c': '', 'u': u.u, 'p': u.p}} ORDER BY u.id, u.k)),
      lambda a, s: {{'c': replace(a.c, s.u, s.p), 'u': '', 'p': ''}}).c AS text FROM linked_posts p JOIN linked_urls u ON u.site = p.site{held} GROUP BY ALL)"""


_REWRITTEN = """SELECT p.site, p.content_type, p.id, coalesce(c.text, p.content) AS content, coalesce(e.text, p.excerpt) AS excerpt FROM linked_posts p
  LEFT JOIN swapped_content c ON c.site = p.site AND c.id = p.id LEFT JOIN swapped_excerpt e ON e.site = p.site AND e.id = p.id"""

ZERO_TIME = "0001-01-01T00:00:00Z"


def rendered(value: str) -> str:
    return f"json_object('rendered', {value})"


POST_JSON = f"""json_object('id', id, 'date', {printed('date')}, 'date_gmt', '{ZERO_TIME}', 'guid', {rendered("''")}, 'modified', {printed('modified')},
  'modified_gmt', '{ZERO_TIME}', 'slug', slug, 'status', status, 'type', 'post', 'link', link, 'title', {rendered('title')},
  'content', {rendered('content')}, 'excerpt', {rendered('excerpt')}, 'author', author, 'featured_media', featured_media, 'comment_status', '',
  'ping_status', '', 'sticky', false, 'template', '', 'format', '', 'meta', NULL, 'categories', categories, 'tags', tags, '_links', json('{{}}'))"""
MEDIA_JSON = f"""json_object('id', s_suppkey, 'date', '{ZERO_TIME}', 'date_gmt', '{ZERO_TIME}', 'guid', {rendered("''")}, 'modified', '{ZERO_TIME}',
  'modified_gmt', '{ZERO_TIME}', 'slug', lower(s_name), 'status', '', 'type', '', 'link', '', 'title', {rendered('s_name')}, 'author', 0,
  'comment_status', '', 'ping_status', '', 'template', '', 'meta', NULL, 'description', {rendered("''")}, 'caption', {rendered("''")},
  'alt_text', '', 'media_type', '', 'mime_type', 'image/png', 'media_details', json('{{}}'), 'post', 0,
  'source_url', 'https://cdn.example.com/' || s_suppkey || '.png', '_links', json('{{}}'))"""
CATEGORY_JSON = """json_object('id', id, 'count', 0, 'description', '', 'link', '', 'name', slug, 'slug', slug, 'taxonomy', 'category', 'parent', parent,
  'meta', NULL, '_links', json('{}'))"""
TAG_JSON = """json_object('id', id, 'count', n, 'description', '', 'link', '', 'name', 'Year ' || id, 'slug', id::VARCHAR, 'taxonomy', 'post_tag',
  'meta', NULL, '_links', json('{}'))"""
USER_JSON = """json_object('id', c_custkey, 'name', c_name, 'url', 'https://shop.example.com/u/' || c_custkey, 'description', '', 'link', '',
  'slug', lower(c_name), 'avatar_urls', json_object('24', 'https://shop.example.com/a/' || c_custkey || '.png'), 'meta', NULL, '_links', json('{}'))"""

TAGS = "tags AS (SELECT site, tags[1] AS id, count(*) AS n FROM order_posts GROUP BY ALL)"
IMAGE = "author % 97 + 1"


def store_posts(rewritten: bool) -> str:
    """Orders with an image, under its local path where it is media of the same store and links are rewritten."""
    local = f"EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = {IMAGE} AND 'site-' || s_nationkey = site)" if rewritten else "false"
    return f"""store_posts AS (SELECT * REPLACE (content || '<img src="' || CASE WHEN {local} THEN 'media/' || ({IMAGE}) || '_' || ({IMAGE}) || '.png'
      ELSE 'https://cdn.example.com/' || ({IMAGE}) || '.png' END || '">' AS content) FROM order_posts)"""


RECORDS = f"""records AS (
  SELECT site, CASE WHEN status = 'private' THEN 'pages' ELSE 'posts' END AS entity, id AS ord, {POST_JSON}::VARCHAR AS record FROM store_posts
  UNION ALL SELECT 'site-' || s_nationkey, 'media', s_suppkey, {MEDIA_JSON}::VARCHAR FROM supplier
  UNION ALL SELECT site, 'categories', id, {CATEGORY_JSON}::VARCHAR FROM category_nodes
  UNION ALL SELECT site, 'tags', id, {TAG_JSON}::VARCHAR FROM tags
  UNION ALL SELECT 'site-' || c_nationkey, 'users', c_custkey, {USER_JSON}::VARCHAR FROM customer)"""
SITES = "sites AS (SELECT DISTINCT 'site-' || n_nationkey AS site, n_nationkey, n_name FROM nation)"


def counted(table: str, site: str, name: str, condition: str = "true") -> str:
    return f"coalesce((SELECT count(*) FROM {table} WHERE {site} = sites.site AND {condition}), 0) AS {name}"


def _lines(keys: tuple[str, ...]) -> str:
    """Lines of the store documents: framing, records with commas, single values."""
    numbers = {key: n for n, key in enumerate(keys)}
    lists = [k for k in keys if k not in ("site", "exported_at", "stats")]

    def opening(key: str) -> str:
        return ("{" if numbers[key] == 0 else ",") + f'"{key}":'

    def closing(key: str) -> str:
        return "}" if key == keys[-1] else ""

    def single(key: str, table: str, value: str) -> str:
        return f"SELECT site, {numbers[key]}, 0, 0, {lit(opening(key))} || {value} || {lit(closing(key))} FROM {table}"

    parts = [f"SELECT site, {numbers[k]} AS key_no, 0 AS part, 0 AS ord, {lit(opening(k) + '[')} AS line FROM sites" for k in lists]
    parts += [f"SELECT site, {numbers[k]}, 2, 0, {lit(']' + closing(k))} FROM sites" for k in lists]
    parts.append(
        "SELECT site, CASE entity " + " ".join(f"WHEN '{k}' THEN {numbers[k]}" for k in lists) + " END, 1, ord, "
        "CASE WHEN ord = min(ord) OVER (PARTITION BY site, entity) THEN '' ELSE ',' END || record FROM records WHERE entity IN ("
        + ", ".join(lit(k) for k in lists) + ")"
    )
    parts.append(single("exported_at", "sites", lit(f'"{RUN_TIME}"')))
    parts.append(single("stats", "stats", """json_object('total_posts', total_posts, 'total_pages', total_pages, 'total_media', total_media,
      'total_categories', total_categories, 'total_tags', total_tags, 'total_users', total_users, 'media_downloaded', 0, 'brute_force_found', 0)::VARCHAR"""))
    if "site" in keys:
        parts.append(single("site", "sites", """json_object('name', n_name, 'description', '', 'url', 'https://shop.example.com/' || n_nationkey,
          'home_url', '', 'admin_email', '', 'timezone', '', 'date_format', '', 'time_format', '', 'start_of_week', 1, 'language', 'en')::VARCHAR"""))
    stats = f"""stats AS (SELECT site, {counted('order_posts o', 'o.site', 'total_posts', "o.status <> 'private'")}, {counted('order_posts o', 'o.site', 'total_pages', "o.status = 'private'")},
      {counted('supplier', "'site-' || s_nationkey", 'total_media')}, {counted('category_nodes c', 'c.site', 'total_categories')},
      {counted('tags t', 't.site', 'total_tags')}, {counted('customer', "'site-' || c_nationkey", 'total_users')} FROM sites)"""
    return f"WITH {ORDER_POSTS}, {store_posts(rewritten=True)}, {CATEGORIES}, {TAGS}, {RECORDS}, {SITES}, {stats} " + " UNION ALL ".join(parts)


ORACLES: dict[str, str] = {
    "html_to_markdown": f"SELECT page_id, {markdown('html')} AS markdown FROM pages",
    "page_markdown": f"""SELECT page_id, 'posts/' || coalesce(nullif({link_folder('url')}, ''), 'uncategorized') || '/' || {file_name(PAGE_SLUG, 'page_id')} AS path,
      {markdown('html')} AS content FROM pages""",
    "link_category": f"""SELECT 'page' AS kind, page_id AS id, {link_folder('url')} AS folder FROM pages
      UNION ALL SELECT 'order', id, {link_folder('link')} FROM (SELECT o_orderkey AS id, {ORDER_LINK} AS link FROM orders)""",
    "markdown_filename": f"""SELECT 'page' AS kind, page_id AS id, {file_name(PAGE_SLUG, 'page_id')} AS file_name FROM pages
      UNION ALL SELECT 'order', o_orderkey, {file_name("(o_orderpriority || ':a/b\\' || o_orderkey)", 'o_orderkey')} FROM orders""",
    "sanitize_names": f"""SELECT p_partkey, {folder("'  ' || p_name || ' / ' || p_brand || '--<\"' || p_type || '\">?*|\\ '")} AS folder FROM part""",
    "site_domain": f"""SELECT page_id, {HOST} AS host, {domain("'--' || url || '--'")} AS odd_name,
      'export/' || {domain(f"regexp_replace({HOST}, '^www[.]', '')")} || '.2024-06-01123045' AS output FROM pages""",
    "parse_times": f"""WITH e AS (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS s FROM events)
      SELECT event_id, event_type <> 'error' AS parsed,
        CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S')
          WHEN 'signup' THEN strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS utc,
        CASE event_type WHEN 'error' THEN '{RUN_TIME}' WHEN 'click' THEN s || '-05:30' WHEN 'signup' THEN s || '+02:00' ELSE s || 'Z' END AS printed FROM e""",
    "front_matter": f"""WITH {ORDER_POSTS}, titled AS (SELECT * REPLACE (title || chr(10) || slug || chr(13) || '\\' AS title) FROM order_posts)
      SELECT site, id, {front_matter('post')} AS front_matter FROM titled""",
    "post_documents": f"""WITH RECURSIVE {ORDER_POSTS}, {PAGE_POSTS}, {CATEGORIES}, {CATEGORY_PATHS},
      posts AS (SELECT * EXCLUDE (broken, content_type) FROM order_posts UNION ALL BY NAME SELECT * FROM page_posts),
      placed AS (SELECT p.*, 'posts/' || coalesce(nullif({link_folder('link')}, ''), c.path, 'uncategorized') || '/' || {file_name('slug', 'p.id')} AS path
        FROM posts p LEFT JOIN category_paths c ON c.site = p.site AND c.id = p.categories[1])
      SELECT site, path, {document('post')} AS content FROM placed {last_write('path')}""",
    "page_documents": f"""WITH {PAGE_POSTS} SELECT site, 'pages/' || {file_name('slug', 'id')} AS path, {document('page')} AS content
      FROM page_posts {last_write('path')}""",
    "site_readme": f"""WITH {SITE_INFO}, s AS (SELECT {SITE_COLUMNS} FROM site_info) SELECT site, 'README.md' AS path, concat_ws(chr(10), '# ' || name, '',
      '**Description:** ' || description || '  ', '**URL:** ' || url || '  ', '**Home URL:** ' || home_url || '  ', '**Admin Email:** ' || admin_email || '  ',
      '**Timezone:** ' || timezone || '  ', '**Language:** ' || language || '  ', '', '---', '', '*Exported on 2024-06-01 12:30:45*', '') AS content FROM s""",
    "category_hierarchy": f"WITH RECURSIVE {CATEGORIES}, {CATEGORY_PATHS} SELECT site, id, depth, path FROM category_paths",
    "category_path": f"""WITH RECURSIVE {ORDER_POSTS}, {CATEGORIES}, {CATEGORY_PATHS}
      SELECT p.site, p.id, coalesce(nullif({link_folder('link')}, ''), c.path, 'uncategorized') AS folder
      FROM order_posts p LEFT JOIN category_paths c ON c.site = p.site AND c.id = p.categories[1]""",
    "gap_ids": f"""WITH {LOOKUPS}, {LISTED}, ranges AS (SELECT content_type, unnest(range(1, max(id) + 1)) AS id FROM lookups GROUP BY content_type)
      SELECT 'store' AS site, content_type, id FROM ranges r WHERE NOT EXISTS (SELECT 1 FROM listed k WHERE k.content_type = r.content_type AND k.id = r.id)""",
    "id_range": f"""WITH {LOOKUPS}, ends AS (SELECT content_type, min(id) AS lo, max(id) AS hi FROM lookups GROUP BY content_type)
      SELECT id, slug, content_type FROM lookups JOIN ends USING (content_type) WHERE status = 200 AND readable
        AND CASE WHEN content_type = 'pages' THEN id = (lo + hi) // 2 ELSE id BETWEEN lo + (hi - lo) // 4 AND hi - (hi - lo) // 4 END""",
    "item_outcome": f"""WITH {LOOKUPS} SELECT content_type, id,
      CASE WHEN status = 200 AND readable THEN 'found' WHEN status = 404 THEN 'missing' ELSE 'error' END AS outcome FROM lookups""",
    "discover": f"WITH {LOOKUPS}, {LISTED}, {DISCOVERED} SELECT 'store' AS site, content_type, id FROM discovered",
    "discover_stream": f"WITH {LOOKUPS}, {LISTED}, {DISCOVERED} SELECT 'store' AS site, content_type, id FROM discovered",
    "discover_stats": f"WITH {LOOKUPS}, {LISTED}, {DISCOVERED} SELECT 'store' AS site, content_type, count(*) AS found FROM discovered GROUP BY ALL",
    "merge_discovered": f"""WITH {LOOKUPS}, {LISTED}, {DISCOVERED}, {ORDER_POSTS} SELECT site, content_type, id, slug, false AS discovered FROM order_posts
      UNION ALL SELECT 'store', 'page', id, slug, true FROM discovered WHERE content_type = 'pages'""",
    "media_filename": f"""WITH {PAGE_MEDIA} SELECT page_id AS id, CASE WHEN url LIKE '%/' THEN page_id || '_media_' || page_id || {MIME} ELSE file END AS file
      FROM page_media JOIN pages ON page_id = id
      UNION ALL SELECT page_id, page_id || '_' || left(repeat('ab', page_id % 60 + 70), 195) || '.jpeg' FROM pages""",
    "mime_extension": f"""SELECT event_id, coalesce(MAP {{{', '.join(f"'{k}': '{v}'" for k, v in MIME_EXTENSIONS.items())}}}[CASE WHEN event_type = 'error' THEN props
      ELSE [{', '.join(f"'{k}'" for k in MIME_EXTENSIONS)}][event_id % {len(MIME_EXTENSIONS)} + 1] END], '{DEFAULT_EXTENSION}') AS extension FROM events""",
    "path_safe": "SELECT page_id, url LIKE 'https:%' AS inside FROM pages",
    "media_variants": f"""WITH {PAGE_MEDIA}, v AS (SELECT *, unnest([{{'n': 'large', 'u': '-1024x768.jpg'}}, {{'n': 'thumbnail', 'u': '-150x150.jpg?v=1'}}]) AS s
        FROM page_media WHERE source_url <> '')
      SELECT site, id AS media_id, s.n AS size_name, bare || s.u AS url,
        'media/' || id || '_' || split_part(regexp_extract(bare, '/([^/]*)$', 1) || s.u, '?', 1) AS local_path FROM v""",
    "media_manifest": f"""WITH {PAGE_MEDIA}, {ATTEMPTS}, {OUTCOMES}, {PRESENT}, {MANIFEST} SELECT *, status IN ('present', 'downloaded') AS downloaded,
      status IN ('present', 'downloaded') AS resolved FROM manifest""",
    "media_downloaded": f"""WITH {PAGE_MEDIA}, {ATTEMPTS}, {OUTCOMES}, {PRESENT}, {MANIFEST}
      SELECT site, count(*) FILTER (status IN ('present', 'downloaded')) AS media_downloaded FROM manifest GROUP BY site""",
    "attempt_outcome": f"WITH {ATTEMPTS}, {OUTCOMES} SELECT * FROM outcomes",
    "media_rewrite": f"""WITH {LINKED_URLS}, {LINKED_POSTS}, {_swapped('content', True)}, {_swapped('excerpt', True)} {_REWRITTEN}""",
    "media_rewrite_exact": f"""WITH {LINKED_URLS}, {LINKED_POSTS}, {_swapped('content', False)}, {_swapped('excerpt', False)} {_REWRITTEN}""",
    "media_rewrite_off": f"WITH {LINKED_POSTS} SELECT site, content_type, id, content, excerpt FROM linked_posts",
    "discover_off": f"WITH {ORDER_POSTS} SELECT site, 'post' AS content_type, id, slug, false AS discovered FROM order_posts",
    "rejected_fields": """SELECT 'user-' || user_id AS site, 'posts' AS endpoint, event_id::INT AS page, 1 AS position, f.field, f.found FROM events
      JOIN (VALUES ('click', 'id', 'STRING'), ('purchase', 'slug', 'ARRAY<STRING>'), ('purchase', 'title', 'OBJECT<rendered: BIGINT>'),
        ('error', 'categories', 'ARRAY<VARIANT>'), ('error', 'content', 'ARRAY<VOID>'), ('error', 'author', 'DECIMAL(2,1)')) AS f(kind, field, found) ON kind = event_type""",
    "pagination_cut": f"WITH {EVENT_LISTING}, {EVENT_CUTS} SELECT * FROM ends",
    "surviving_pages": f"""WITH {EVENT_LISTING}, {EVENT_CUTS} SELECT l.site, l.endpoint, l.page, l.status, l.body
      FROM event_listing l JOIN ends e ON e.site = l.site AND e.endpoint = l.endpoint WHERE NOT failed AND page < end_page AND status = 200""",
    "scan_posts": f"""WITH {ORDER_POSTS}, listed AS (SELECT *, CASE WHEN status = 'private' THEN 'page' ELSE 'post' END AS kind, {listed_page('id')} AS page FROM order_posts),
      failed AS (SELECT DISTINCT site, kind FROM listed WHERE broken)
      SELECT site, kind AS content_type, page * 2147483648 + row_number() OVER (PARTITION BY site, kind, page ORDER BY id) - 1 AS ord, id, date, modified, slug,
        status, link, title, content, excerpt, author, featured_media, coalesce(categories[1], 0) AS category, len(tags) AS tags, false AS sticky, '' AS template
      FROM listed l WHERE NOT EXISTS (SELECT 1 FROM failed f WHERE f.site = l.site AND f.kind = l.kind)""",
    "scan_media": f"""SELECT {HOST} AS site, (page_id // 100 + 1) * 2147483648 + row_number() OVER (PARTITION BY {HOST}, page_id // 100 ORDER BY page_id) - 1 AS ord,
      page_id AS id, url AS source_url, '' AS alt_text, length(html) AS width, length(html) AS height, 'STRING' AS height_kind, url || '&thumb' AS thumb FROM pages""",
    "scan_terms": f"""WITH {ORDER_POSTS}, {CATEGORIES}, {TAGS} SELECT site, id, slug AS name, slug, 'category' AS taxonomy, parent, 0 AS count FROM category_nodes
      UNION ALL SELECT site, id, 'Year ' || id, id::VARCHAR, 'post_tag', 0, n FROM tags""",
    "scan_users": f"""SELECT 'site-' || c_nationkey AS site, {listed_page('c_custkey')} * 2147483648
        + row_number() OVER (PARTITION BY c_nationkey, {listed_page('c_custkey')} ORDER BY c_custkey) - 1 AS ord, c_custkey AS id, c_name AS name,
      lower(c_name) AS slug, 'https://shop.example.com/u/' || c_custkey AS url, '' AS description, 'https://shop.example.com/a/' || c_custkey || '.png' AS avatar FROM customer""",
    "site_info": f"WITH {SITE_INFO} SELECT {SITE_COLUMNS} FROM site_info",
    "offset_cut": f"""WITH {ORDER_POSTS}, calls AS (SELECT site, id // {IDS_PER_PAGE} * 100 AS o, count(*) AS n FROM order_posts GROUP BY ALL),
      judged AS (SELECT *, length(site) = 6 AND o = right(site, 1)::INT % 3 * 100 AS error FROM calls),
      cuts AS (SELECT site, min(o) FILTER (n < 100 AND NOT error) AS short_offset, min(o) FILTER (error) AS error_offset, max(o) AS max_offset FROM judged GROUP BY site)
      SELECT site, 'wp.getPosts' AS method, short_offset, error_offset, coalesce(short_offset, max_offset) AS last_offset,
        error_offset IS NOT NULL AND (short_offset IS NULL OR error_offset < short_offset) AS failed FROM cuts""",
    "rpc_outcome": """WITH e AS (SELECT *, event_type IN ('view', 'signup') OR (event_type = 'purchase' AND value <= 50) AS ok FROM events)
      SELECT 'user-' || user_id AS site, event_id AS offset, CASE WHEN ok THEN 'ok' ELSE 'error' END AS outcome,
        CASE WHEN ok AND event_type <> 'signup' THEN 2 ELSE 0 END AS records FROM e""",
    "rpc_posts": f"""WITH {ORDER_POSTS} SELECT site || '-' || id // {IDS_PER_PAGE} AS site, CASE WHEN status = 'private' THEN 'page' ELSE 'post' END AS content_type, id, date,
      slug, status, author, link, CASE WHEN status = 'private' THEN 0 ELSE featured_media END AS featured_media, title, content,
      CASE WHEN status <> 'private' THEN id END AS custom_id, CASE WHEN status <> 'private' THEN title || ' <b> & \\' END AS custom_value FROM order_posts""",
    "rpc_site_info": """SELECT DISTINCT 'site-' || n_nationkey AS site, n_name AS name, '' AS description, 'https://site-' || n_nationkey AS url, '' AS home_url,
      '' AS timezone, '' AS language FROM nation""",
    "rpc_users": f"""SELECT 'site-' || c_nationkey || '-' || c_custkey // {IDS_PER_PAGE} AS site, c_custkey AS id, c_name AS name, lower(c_name) AS slug,
      'https://shop.example.com/u/' || c_custkey AS url FROM customer""",
    "rpc_media": f"""SELECT 'site-' || s_nationkey || '-' || s_suppkey // {IDS_PER_PAGE} AS site, s_suppkey AS id, s_name AS title, 'image/png' AS mime_type,
      'https://cdn.example.com/' || s_suppkey || '.png' AS source_url, s_suppkey || '.png' AS file, (s_suppkey % 2000)::BIGINT AS width,
      'https://cdn.example.com/' || s_suppkey || '-150x150.png' AS thumbnail, 150::BIGINT AS thumbnail_width FROM supplier""",
    "rpc_terms": f"""WITH {ORDER_POSTS}, {CATEGORIES}, {TAGS} SELECT site || '-' || id // {IDS_PER_PAGE} AS site, id, slug, parent FROM category_nodes
      UNION ALL SELECT site || '-' || id // {IDS_PER_PAGE}, id, id::VARCHAR, 0 FROM tags""",
    "export_stats": f"""WITH {ORDER_POSTS}, {CATEGORIES}, {TAGS}, {SITES}, {LOOKUPS}, {LISTED}, {DISCOVERED},
      found AS (SELECT 'site-0' AS site FROM discovered WHERE content_type = 'posts'), posts AS (SELECT site, status FROM order_posts UNION ALL SELECT site, '' FROM found)
      SELECT site, {counted('posts p', 'p.site', 'total_posts', "p.status <> 'private'")}, {counted('posts p', 'p.site', 'total_pages', "p.status = 'private'")}, {counted('supplier', "'site-' || s_nationkey", 'total_media')},
        {counted('category_nodes c', 'c.site', 'total_categories')}, {counted('tags t', 't.site', 'total_tags')},
        {counted('customer', "'site-' || c_nationkey", 'total_users')}, {counted('supplier', "'site-' || s_nationkey", 'media_downloaded', 's_acctbal > 0')},
        {counted('found f', 'f.site', 'brute_force_found')} FROM sites""",
    "export_records": f"WITH {ORDER_POSTS}, {store_posts(rewritten=False)}, {CATEGORIES}, {TAGS}, {RECORDS} SELECT * FROM records",
    "export_json": _lines(("site", "posts", "pages", "media", "categories", "tags", "users", "exported_at", "stats")),
    "export_metadata": _lines(("categories", "exported_at", "media", "stats", "tags", "users")),
}
