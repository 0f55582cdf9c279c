import datetime as dt

from pyspark.sql import functions as F

from sitefold.functions.folders import is_numeric, link_folder
from sitefold.functions.links import is_inside, is_valid_url, url_host, url_path
from sitefold.functions.markup import html_to_markdown, yaml_text
from sitefold.functions.names import (
    domain_name,
    file_name,
    folder_name,
    markdown_file_name,
    media_file_name,
    mime_extension,
    size_file_name,
)
from sitefold.functions.times import is_time, parse_time, print_time


def check(evaluate, column, cases):
    got = evaluate([(a,) for a, _ in cases], "x string", column)
    assert got == [b for _, b in cases], [(c, g) for c, g in zip(cases, got) if c[1] != g]


def test_link_folder(evaluate):
    check(evaluate, link_folder("x"), [
        # folders above the last segment, whatever follows the path
        ("https://garden.test/roses/climbing/first-bloom", "roses/climbing"),
        ("https://garden.test/first-bloom", ""),
        ("https://garden.test/soil/compost-heap/", "soil"),
        ("https://garden.test/bulbs%2Ftulips/red?from=/x/y#/p/q", "bulbs/tulips"),
        # dates, numbers and skipped words
        ("https://garden.test/1998/11/03/first-frost", ""),
        ("https://garden.test/frost/1998/11/first-frost", "frost"),
        ("https://garden.test/archives/77/leaf", ""),
        ("https://garden.test/blog/posts/hedges/box", "hedges"),
        ("https://garden.test/category/hedges/yew/clip/it", "hedges/yew/clip"),
        ("https://garden.test/ca tegory/7up/x", "ca-tegory/7up"),
        # characters that do not belong into a folder name
        ("https://garden.test/herb bed/sage", "herb-bed"),
        ("https://garden.test/1+1/two", "1+1"),
        ("https://garden.test/Kräuter/Salbei", "Kräuter"),
        # dots are resolved, but not above the top
        ("https://garden.test/shed/../pond/frog", "pond"),
        ("https://garden.test/../../../pond/frog", "pond"),
        ("https://garden.test/pond/../frog", "."),
        ("https://garden.test/pond///reeds//frog", "pond/reeds"),
        # no folder to be had
        ("https://garden.test", ""), ("pond-and-frog", ""), ("", ""), (None, ""), ("ga rden://x/pond/frog", ""), ("https://garden.test/50%/frog", ""),
    ])


def test_is_numeric(evaluate):
    check(evaluate, is_numeric("x"), [
        ("7", True), ("0042", True), ("31415926535897932384626433", True), ("", False), (" 7", False), ("7 ", False), ("0x1F", False), ("1e3", False),
        ("+7", False), ("7,5", False), ("v7", False), ("7\n", False), ("７", False), ("٣", False), ("½", False),
    ])


def test_folder_name(evaluate):
    check(evaluate, folder_name("x"), [
        ("pond", "pond"), ("lily pond", "lily-pond"), ("\"q\"|a<b>c", "q-a-b-c"), ("x:y*z?", "x-y-z"), ("one\\two/three", "one-two-three"),
        ("- - -", "category"), ("", "category"), ("a -  - b", "a-b"), ("v2.0_final", "v2.0_final"), ("Äpfel & Öl", "Äpfel-&-Öl"), ("-x-", "x"), ("tab\there", "tab\there"),
    ])


def test_domain_name(evaluate):
    check(evaluate, domain_name("x"), [
        ("garden.test", "garden.test"), ("m.garden.test", "m.garden.test"), ("old garden.test:81", "old-garden.test-81"), ("a<b>|c*?.org", "a-b-c.org"),
        ("--pond--life--.net", "pond-life.net"), ("  pond .net ", "pond.net"), ("pond/\\\"life", "pond-life"), ("nodots-", "nodots"),
        ("-- --", "wordpress-site"), ("", "wordpress-site"), ("--.org", ".org"), (".org", ".org"), ("a.b-.c", "a.b.c"),
    ])


def test_html_to_markdown(evaluate):
    check(evaluate, html_to_markdown("x"), [
        ("<h1>Pond</h1><h2>Frogs</h2>", "# Pond\n\n## Frogs"),
        ("<ul><li>reed</li><li>lily</li></ul>", "- reed\n- lily"),
        ("<pre>ribbit()</pre>", "```\nribbit()\n```"),
        ("<p>wet</p><p>dry</p>", "wet\n\ndry"),
        ("<em>k</em><strong>l</strong><i>m</i><b>n</b>", "*k***l***m***n**"),
        ("k<br />l<br>m<br/>n", "k\nl\nm\nn"),
        ("<code>frog</code>", "`frog`"),
        ('<p id="pond">wet', '<p id="pond">wet'),
        ('<a href="/pond">go</a>', '<a href="/pond">go</a>'),
        ("k" + "\n" * 5 + "l", "k\n\n\n\nl"),
        ("　\t wet \r\n", "wet"),
        ("<o<p>l>wet", "wet"),
        (None, ""),
    ])


def test_yaml_text(evaluate):
    check(evaluate, yaml_text("x"), [
        ('the "pond"', 'the \\"pond\\"'), ("wet\ndry\n", "wet\\ndry\\n"), ("wet\r\ndry", "wet\\r\\ndry"), ("k\tl", "k\tl"), ("k\\l", "k\\l"), ('\\"', '\\\\"'), ("", ""),
    ])


def test_markdown_file_name(evaluate):
    rows = [("frog-pond_9", 4), ("", 31), ("7", 5), ("pond.v2", 6), ("reed\\lily/frog:toad", 8), (None, 12)]
    got = evaluate(rows, "s string, n bigint", markdown_file_name("s", "n"))
    assert got == ["frog-pond_9.md", "post-31.md", "7.md", "pond.v2.md", "reed-lily-frog-toad.md", "post-12.md"]


def test_file_name(evaluate):
    check(evaluate, file_name("x"), [
        ("frog.webp", "frog.webp"), ("my frog.webp", "my frog.webp"), ("pond\\a/b.gif", "pond_a_b.gif"), ("frog|<1>.gif", "frog__1_.gif"),
        ("k:l*m?n\"o", "k_l_m_n_o"), ("", ""),
        # 200 bytes at most, the extension stays, and no character is split
        ("f" * 197 + ".gif", "f" * 196 + ".gif"), ("ü" * 120 + ".webp", "ü" * 97 + ".webp"), ("z" * 240, "z" * 200), ("ab" + "ü" * 120 + ".gif", "ab" + "ü" * 97 + ".gif"),
    ])


def test_mime_extension(evaluate):
    check(evaluate, mime_extension("x"), [
        ("audio/ogg", ".ogg"), ("image/webp", ".webp"), ("video/webm", ".webm"), ("application/zip", ".zip"), ("image/svg+xml", ".svg"),
        ("model/gltf", ".bin"), ("IMAGE/PNG", ".bin"), ("", ".bin"), (None, ".bin"),
    ])


def test_media_file_name(evaluate):
    rows = [
        (41, "https://cdn.test/2019/07/frog-spawn.webp", "image/webp"),
        (42, "https://cdn.test/toad [big].gif", "image/gif"),
        (43, "https://cdn.test", "image/webp"),
        (44, "https://cdn.test/", "video/webm"),
        (45, "https://cdn.test/k/pond.tar.xz?size=9#top", ""),
        (46, "https://cdn.test/k/two%20frogs.gif/", ""),
        (47, "https://cdn.test/50%.gif", ""),
        (48, "frog", ""),
        (49, "https://cdn.test/why%3F.gif", ""),
    ]
    got = evaluate(rows, "n bigint, u string, m string", media_file_name("n", "u", "m"))
    assert got == [
        "41_frog-spawn.webp", "42_toad [big].gif", "43_media_43.webp", "44_media_44.webm", "45_pond.tar.xz", "46_two frogs.gif", None, "48_frog", "49_why_.gif",
    ]


def test_size_file_name(evaluate):
    rows = [
        (61, "https://cdn.test/k/frog-640x480.gif", "https://cdn.test/k/frog.gif", ""),
        (62, "https://cdn.test", "https://cdn.test/toad.gif", ""),
        (63, "https://cdn.test/", "https://cdn.test/toad.gif", ""),
        (64, "https://cdn.test/9%", "https://cdn.test/toad.gif", ""),
    ]
    got = evaluate(rows, "n bigint, s string, u string, m string", size_file_name("n", "s", "u", "m"))
    assert got == ["61_frog-640x480.gif", "62_.", "63__", "64_toad.gif"]


def test_urls(evaluate):
    cases = [
        ("https://a.com/x", True, "/x", "a.com"), ("//a.com/x", True, "/x", "a.com"), ("///x", True, "///x", ""),
        ("mailto:a@b.c", True, "", ""), ("a:b/c", True, "", ""), ("1a:b", False, None, None), (":x", False, None, None),
        ("x/a:b", True, "x/a:b", ""), ("https://u:p@a.com:8080/x?y#z", True, "/x", "a.com"),
        ("https://a.com:80b/", False, None, None), ("https://[::1]:80/x", True, "/x", "::1"),
        ("https://a b.com/", False, None, None), ("https://a.com/b c", True, "/b c", "a.com"),
        ("https://a.com/\x01", False, None, None), ("https://a.com/x#%zz", False, None, None),
        ("https://a.com/x?%zz", True, "/x", "a.com"), ("", True, "", ""), ("#top", True, "", ""),
        ("?q", True, "", ""), ("http:///p", True, "/p", ""), ("https://münchen.de/ä", True, "/ä", "münchen.de"),
        ("ht tp://invalid url with spaces", False, None, None), ("https://a.com", True, "", "a.com"),
    ]
    urls = [(c[0],) for c in cases]
    assert evaluate(urls, "x string", is_valid_url("x")) == [c[1] for c in cases]
    assert evaluate(urls, "x string", url_path("x")) == [c[2] for c in cases]
    assert evaluate(urls, "x string", url_host("x")) == [c[3] for c in cases]


def test_is_inside(evaluate):
    check(evaluate, is_inside("x", "'/pond/reeds'"), [
        ("/pond/reeds", True), ("/pond/reeds/frog.gif", True), ("/pond/reeds/k/l/m.gif", True), ("/pond/reeds/k/../../reeds/x", True), ("/pond/reeds/..frog", False),
        ("/pond/frog.gif", False), ("/pond/reeds/../frog.gif", False), ("/pond/reedsy/frog.gif", False), ("/shed/key", False), ("../../frog.gif", False), ("reeds/frog.gif", False),
    ])


def test_times(evaluate):
    utc = dt.datetime(2011, 7, 9, 10, 4, 58)
    cases = [
        ("2011-07-09T10:04:58", utc, "2011-07-09T10:04:58Z"),
        ("2011-07-09T10:04:58Z", utc, "2011-07-09T10:04:58Z"),
        ("2011-07-09T10:04:58-05:00", utc + dt.timedelta(hours=5), "2011-07-09T10:04:58-05:00"),
        ("2011-07-09T10:04:58+03:00", utc - dt.timedelta(hours=3), "2011-07-09T10:04:58+03:00"),
        ("2011-07-09T10:04:58+00:00", utc, "2011-07-09T10:04:58Z"),
        ("2011-07-09T10:04:58.654321987Z", utc.replace(microsecond=654321), "2011-07-09T10:04:58Z"),
        ("2011-07-09T10:04:58.5+01:00", utc.replace(hour=9, microsecond=500000), "2011-07-09T10:04:58+01:00"),
        ("2011-07-09T5:04:58", utc.replace(hour=5), "2011-07-09T05:04:58Z"),
        ("2011-07-09T10:04:58+24:00", utc - dt.timedelta(hours=24), "2011-07-09T10:04:58+24:00"),
        ("2011-07-09", None, "NOW"), ("2011-07-09 10:04:58", None, "NOW"), ("2011-02-30T10:00:00", None, "NOW"),
        ("2011-07-09T25:00:00", None, "NOW"), ("some day", None, "NOW"), ("2011-07-09T10:04:58+25:00", None, "NOW"),
        ("", None, "0001-01-01T00:00:00Z"),
    ]
    rows = [(c[0],) for c in cases]
    expected = [c[1] and round(c[1].replace(tzinfo=dt.timezone.utc).timestamp() * 1e6) for c in cases]
    assert evaluate(rows, "x string", F.unix_micros(parse_time("x"))) == expected
    assert evaluate(rows, "x string", is_time("x")) == [c[1] is not None for c in cases]
    assert evaluate(rows, "x string", print_time("x", "NOW")) == [c[2] for c in cases]


def test_markdown_equals_replacing_in_turn(evaluate):
    """Against the plain loop, on texts with split, nested and repeated tags."""
    import random

    from sitefold.functions.markup import TAG_REPLACEMENTS, WHITE_SPACE

    rng = random.Random(3)
    bits = [old for old, _ in TAG_REPLACEMENTS] + ["<", ">", "u", "l>", "/", "h1>", "p", " ", "\n", "<p ", "é", "<u", "o", "<<", "strong>", "a>b"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(1500)]

    def plain(value):
        for old, new in TAG_REPLACEMENTS:
            value = value.replace(old, new)
        return value.replace("\n\n\n", "\n\n").strip(WHITE_SPACE)

    check(evaluate, html_to_markdown("x"), [(t, plain(t)) for t in texts])
