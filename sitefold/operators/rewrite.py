"""Media URLs in content replaced by local paths.

A URL is replaced wherever it occurs as a substring, so a token join is not
enough: ``https://a/b.jp`` also occurs inside ``https://a/b.jpg``. Every URL has
an anchor: the first ``://`` in it, else the first dot, else the first slash. An
occurrence in a text stands around the same anchor, so the pieces that lie around
the anchors of a text as some URL of its site lies around its own, and that begin
and end with the same characters, contain every occurrence. Hashing those pieces
turns the substring search into an equi-join, without pairing posts with media.
Only URLs with no anchor at all, such as ``logo``, are looked for at every character,
and only on sites that have one.

A hash that matches by accident is harmless, since replacing a URL that is not
there changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefold.functions.sqltext import bind, lit
from sitefold.operators.joins import BROADCAST_BYTES, fits_broadcast, lookup_join, materialised
from sitefold.operators.media import link_path, media_urls

POST_KEY = ["site", "content_type", "ord"]
# Anchors in the order in which they are tried.
_ANCHORS = {"scheme": "://", "dot": ".", "slash": "/"}
_BARE = "bare"


def _kind(url: Column) -> Column:
    cases = [F.when(url.contains(mark), F.lit(name)) for name, mark in _ANCHORS.items()]
    return F.coalesce(*cases, F.lit(_BARE))


def replacements(media: DataFrame) -> DataFrame:
    """(site, url, local_path, rank) in the order in which URLs are replaced.

    Items follow their listing order; an item's own URL comes before its sizes,
    which follow by name. Of equal URLs only the first can ever apply.
    """
    rank = F.struct("ord", F.col("size_name").isNotNull().alias("is_size"), F.coalesce("size_name", F.lit("")).alias("size_name"))
    return (
        media_urls(media)
        .select("site", "url", rank.alias("rank"), link_path(F.col("file")).alias("local_path"))
        .groupBy("site", "url")
        .agg(F.min(F.struct("rank", "local_path")).alias("first"))
        .select("site", "url", "first.local_path", "first.rank")
    )


def _url_shapes(urls: DataFrame) -> DataFrame:
    """Per site and kind, how URLs lie around their anchor: (site, shapes, spans).

    A shape is the number of characters before the anchor, the length of the URL, and
    the characters URLs of that shape begin and end in; a span is the most anchors one
    URL holds. Both are bounded by the longest URL and the alphabet, not by the number of media.
    """
    url, kind = F.col("url"), F.col("kind")
    marks = [(F.when(kind == name, F.instr(url, mark) - 1), F.when(kind == name, F.size(F.split(url, F.lit("\\Q" + mark + "\\E"))) - 1)) for name, mark in _ANCHORS.items()]
    shapes = (
        urls.withColumn("kind", _kind(url))
        .select(
            "site",
            "kind",
            F.coalesce(*[before for before, _ in marks], F.lit(0)).alias("before"),
            F.length(url).alias("n"),
            F.left(url, F.lit(1)).alias("first"),
            F.right(url, F.lit(1)).alias("last"),
            F.coalesce(*[span for _, span in marks], F.lit(0)).alias("span"),
        )
        .groupBy("site", "kind", "before", "n")
        .agg(
            F.array_join(F.array_sort(F.collect_set("first")), "").alias("firsts"),
            F.array_join(F.array_sort(F.collect_set("last")), "").alias("lasts"),
            F.max("span").alias("span"),
        )
    )
    kinds = [*_ANCHORS, _BARE]
    shape = F.struct("before", "n", "firsts", "lasts")
    return shapes.groupBy("site").agg(
        F.struct(
            *[F.array_sort(F.collect_list(F.when(kind == name, shape))).alias(name) for name in kinds],
            *[F.coalesce(F.max(F.when(kind == name, F.col("span"))), F.lit(0)).alias(f"{name}_span") for name in kinds],
            *[F.coalesce(F.max(F.when(kind == name, F.col("n"))), F.lit(0)).alias(f"{name}_longest") for name in kinds],
        ).alias("shapes")
    )


_NONE = "CAST(array() AS ARRAY<BIGINT>)"


def _anchored_pieces(content: str, name: str) -> str:
    """Hashes of all pieces around an anchor of the content that look like a URL of the site."""
    mark, shapes = _ANCHORS[name], f"shapes.{name}"

    def around(parts: str) -> str:
        joined = f"array_join(slice({parts}, i + 1, shapes.{name}_span), {lit(mark)})"

        def pieces(tail: str) -> str:
            own = f"element_at({parts}, i)"
            rest = f"u.n - u.before - {len(mark)}"
            inside = f"u.before <= length({own}) AND {rest} <= length({tail})"
            begin = f"CASE WHEN u.before > 0 THEN substring({own}, -u.before, 1) ELSE {lit(mark[0])} END"
            end = f"CASE WHEN {rest} > 0 THEN substring({tail}, {rest}, 1) ELSE {lit(mark[-1])} END"
            like = f"filter({shapes}, u -> {inside} AND contains(u.firsts, {begin}) AND contains(u.lasts, {end}))"
            piece = f"concat(right({own}, u.before), {lit(mark)}, substring({tail}, 1, {rest}))"
            return f"transform({like}, u -> xxhash64({piece}))"

        longest = f"shapes.{name}_longest"
        return f"flatten(transform(sequence(1, size({parts}) - 1), i -> {bind(f'left({joined}, {longest})', pieces)}))"

    found = bind(f"split({content}, {lit('\\Q' + mark + '\\E')}, -1)", lambda parts: f"CASE WHEN size({parts}) > 1 THEN {around(parts)} ELSE {_NONE} END")
    return f"CASE WHEN size({shapes}) > 0 AND contains({content}, {lit(mark)}) THEN {found} ELSE {_NONE} END"


def _bare_pieces(content: str) -> str:
    """Hashes of all pieces of the lengths of URLs without an anchor, at every character."""
    shapes = f"shapes.{_BARE}"

    def at_each(letters: str) -> str:
        piece = f"array_join(slice({letters}, i, u.n), '')"
        fits = f"i + u.n - 1 <= size({letters}) AND contains(u.firsts, element_at({letters}, i)) AND contains(u.lasts, element_at({letters}, i + u.n - 1))"
        return f"flatten(transform(sequence(1, size({letters})), i -> transform(filter({shapes}, u -> {fits}), u -> xxhash64({piece}))))"

    found = bind(f"split({content}, '')", at_each)
    return f"CASE WHEN size({shapes}) > 0 AND {content} <> '' THEN {found} ELSE {_NONE} END"


def _occurring(texts: DataFrame, columns: list[str], urls: DataFrame, shapes: DataFrame) -> DataFrame:
    """(post key, rank, url, local_path) of the replacements that may occur in the text columns."""
    shaped = lookup_join(texts, shapes, ["site"], "inner", ["ord"])
    found = [_anchored_pieces(c, name) for c in columns for name in _ANCHORS] + [_bare_pieces(c) for c in columns]
    pieces = shaped.selectExpr(*POST_KEY, f"explode(array_distinct(concat({', '.join(found)}))) AS url_hash")
    hashed = urls.withColumn("url_hash", F.xxhash64("url"))
    # A URL that a third of all posts carry makes one hot key on the left of an
    # inner join, which adaptive execution splits; the next step shuffles anyway.
    return pieces.join(hashed, ["site", "url_hash"]).select(*POST_KEY, "rank", "url", "local_path")


def _swaps(found: DataFrame) -> DataFrame:
    """Per post its replacements in order. The list of one post is bounded by the post's own text."""
    return found.groupBy(*POST_KEY).agg(F.array_sort(F.collect_set(F.struct("rank", "url", "local_path"))).alias("swaps"))


_TEXTS = ("content", "excerpt")


def rewrite_candidates(posts: DataFrame, urls: DataFrame, exact: bool = False) -> DataFrame:
    """Per post, the replacements that may occur in its content or excerpt, in order."""
    return _swaps(occurrences(posts, urls, exact))


def occurrences(posts: DataFrame, urls: DataFrame, exact: bool = False) -> DataFrame:
    """(post key, rank, url, local_path) of the replacements that may occur in the content or excerpt of posts.

    With ``exact``, URLs that only an earlier replacement forms are found as well: what each replacement
    has put in is searched with its surroundings, until no further URL turns up. Each round is a job over changed posts only.
    """
    urls = materialised(urls) if exact else urls
    shapes = materialised(_url_shapes(urls))
    names = [f"text_{t}" for t in _TEXTS]
    texts = posts.selectExpr(*POST_KEY, *[f"coalesce({t}.rendered, '') AS text_{t}" for t in _TEXTS])
    found = _occurring(texts, names, urls, shapes)
    if not exact:
        return found
    known = changed = materialised(found)
    longest = urls.agg(F.max(F.length("url"))).first()[0] or 0
    while not changed.isEmpty():
        # What has not changed would be searched with the same result.
        swaps = _swaps(known.join(changed.select(*POST_KEY).distinct(), POST_KEY, "left_semi"))
        steps = [_formed(name, longest) for name in names]
        formed = texts.join(swaps, POST_KEY).selectExpr(*POST_KEY, f"explode(array_distinct(concat({', '.join(steps)}))) AS text")
        fresh = _occurring(formed, ["text"], urls, shapes).dropDuplicates([*POST_KEY, "url"])
        changed = materialised(fresh.join(known.select(*POST_KEY, "url"), [*POST_KEY, "url"], "left_anti"))
        known = materialised(known.unionByName(changed))
    return known


def _formed(text: str, longest: int) -> str:
    """The parts of a text in which its replacements, one after the other, may have formed a URL.

    Such a URL touches what was put in, so it lies within the length of the longest URL around it. Where two places are
    closer to each other than that, the whole text stands for them.
    """

    def around(parts: str) -> str:
        apart = f"forall(slice({parts}, 2, size({parts}) - 2), p -> length(p) >= {longest})"
        part = f"concat(right(element_at({parts}, i), {longest}), s.local_path, left(element_at({parts}, i + 1), {longest}))"
        return f"CASE WHEN {apart} THEN transform(sequence(1, size({parts}) - 1), i -> {part}) ELSE array(array_join({parts}, s.local_path)) END"

    cut = "split(replace(d.text, s.url, '\\0'), '\\0', -1)"
    step = f"named_struct('text', replace(d.text, s.url, s.local_path), 'parts', concat(d.parts, {bind(cut, around)}))"
    start = f"named_struct('text', {text}, 'parts', CAST(array() AS ARRAY<STRING>))"
    return f"aggregate(swaps, {start}, (d, s) -> CASE WHEN contains(d.text, s.url) THEN {step} ELSE d END, d -> d.parts)"


def rewrite_media_links(
    posts: DataFrame, media: DataFrame, enabled: bool = True, exact: bool = False, bound: int = BROADCAST_BYTES
) -> DataFrame:
    """Posts and pages with media URLs in content and excerpt pointing to local files.

    ``exact`` also replaces URLs that an earlier replacement has formed. Posts of a site that uses few URLs are
    rewritten in place by the list of these, however many posts there are. For the other sites the replacements of posts
    are measured: within ``bound`` bytes they are broadcast, and texts are not shuffled. Beyond it only the texts of posts
    that have any are, as long as their keys fit.
    """
    if not enabled:
        return posts
    found = materialised(occurrences(posts, replacements(media), exact))
    lists = materialised(_site_lists(found))
    if not fits_broadcast(lists, bound):
        return _rewritten_by_post(posts, found, bound)
    rest = materialised(found.join(F.broadcast(lists.select("site")), "site", "left_anti"))
    if not rest.isEmpty():
        posts = _rewritten_by_post(posts, rest, bound)
    if lists.isEmpty():
        return posts
    # Only what the text as given holds is replaced, unless URLs that replacements form count too.
    held = " OR ".join(f"coalesce(contains({t}.rendered, s.url), false)" for t in _TEXTS)
    swaps = "listed" if exact else f"filter(listed, s -> {held})"
    return _applied(posts.join(F.broadcast(lists.withColumnRenamed("swaps", "listed")), "site", "left").withColumn("swaps", F.expr(swaps)).drop("listed"))


# Most URLs of a site that are all looked for in each of its posts.
_FEW = 16


def _site_lists(found: DataFrame) -> DataFrame:
    """(site, swaps): the replacements of each site whose posts use few different ones, in order."""
    used = materialised(found.groupBy("site", "url").agg(F.first("rank").alias("rank"), F.first("local_path").alias("local_path")))
    few = used.groupBy("site").count().where(F.col("count") <= _FEW).select("site")
    return (
        used.join(few, "site", "left_semi")
        .groupBy("site")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "url", "local_path"))).alias("swaps"))
    )


def _applied(joined: DataFrame) -> DataFrame:
    """The replacements in ``swaps`` made one after the other; NULL stands for none."""

    def rewritten(name: str) -> Column:
        body = F.aggregate("swaps", F.col(name)["rendered"], lambda text, s: F.replace(text, s["url"], s["local_path"]))
        kept = F.when(F.col("swaps").isNull(), F.col(name)["rendered"]).otherwise(body)
        return F.col(name).withField("rendered", kept)

    return joined.withColumns({name: rewritten(name) for name in _TEXTS}).drop("swaps")


def _rewritten_by_post(posts: DataFrame, found: DataFrame, bound: int) -> DataFrame:
    swaps = materialised(_swaps(found))
    # Most posts hold no URL of a medium. Their texts stay where they are as long as what is sent to them fits.
    if fits_broadcast(swaps, bound):
        return _applied(posts.join(F.broadcast(swaps), POST_KEY, "left"))
    keys = materialised(swaps.select(*POST_KEY))
    if fits_broadcast(keys, bound):
        touched = posts.join(F.broadcast(keys), POST_KEY, "left_semi").join(swaps, POST_KEY)
        return _applied(touched).unionByName(posts.join(F.broadcast(keys), POST_KEY, "left_anti"))
    return _applied(posts.join(swaps, POST_KEY, "left"))
