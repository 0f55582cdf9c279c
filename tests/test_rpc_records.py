from sitefold.functions.rpcrecords import plain_records
from sitefold.sources import rpc

HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<methodResponse>\n<params><param><value><array><data>\n'
TAIL = "</data></array></value></param></params></methodResponse>\n"


def record(*members):
    return "<value><struct>" + "".join(f"<member><name>{n}</name><value>{v}</value></member>\n" for n, v in members) + "</struct></value>"


PLAIN = [
    (("t", "<string>a &amp; &lt;b&gt; &quot;q&quot; \\ \n</string>"), ("u", "untyped > "), ("i", "<int>007</int>"), ("b", "<boolean>1</boolean>"), ("e", "")),
    (("n", "<struct><member><name>x</name><value><double>1.50</double></value></member></struct>"), ("l", "<array><data><value>[</value>\n<value><i4>1</i4></value></data></array>")),
    (("brace", "<string>{no record</string>"), ("brace", "<string>again</string>")),
]
ODD = [
    "<value><string>text</string></value>", record(("a", "<nil/>")), record(("a", "<string> </string>")), record(("a", "<string><![CDATA[<x>]]></string>")),
    record(("a", "<string>&#8217;</string>")), record(("a", "<string>x</int>")), record(("a", "x")) + "</data>", record(("a", "<string>&no;</string>")),
    record(("a", "x")) + "</data></array></value><value><array><data>" + record(("b", "y")), record(("a", "<string></string>")), "",
]


def test_plain_answers_are_decoded_without_the_xml_parser():
    first, second, third = [plain_records(HEAD + record(*r) + TAIL)[0] for r in PLAIN]
    assert first == [("t", 'a & <b> "q" \\ \n', None), ("u", "untyped > ", None), ("i", "007", None), ("b", "1", None), ("e", "", None)]
    assert second == [("n", "", '{"x":1.50}'), ("l", "", '["[",1]')]
    assert third == [("brace", "{no record", None), ("brace", "again", None)]
    assert [plain_records(HEAD + body + TAIL) for body in ODD] == [None] * len(ODD)


def test_both_ways_of_decoding_agree(spark):
    """A comment sends the same answer through the XML parser."""
    bodies = [HEAD + record(*r) + TAIL for r in PLAIN]
    rows = [(f"{i}-{way}", "wp.getPosts", 0, 200, body) for i, plain in enumerate(bodies) for way, body in enumerate((plain, plain.replace("<params>", "<!-- --><params>")))]
    calls = spark.createDataFrame(rows, "site STRING, method STRING, offset INT, status INT, body STRING")
    found = {r.site: (r.outcome, r.records, r["items"]) for r in rpc._decoded(calls).collect()}
    assert all(found[f"{i}-0"] == found[f"{i}-1"] and found[f"{i}-0"][:2] == ("ok", 1) for i in range(len(bodies)))


def test_ends_of_sequences_come_from_short_batches(spark):
    rows = [("s", "wp.getPosts", offset, 200, HEAD + record(*PLAIN[0]) * n + TAIL) for offset, n in ((0, 2), (2, 1), (4, 2))]
    cuts = rpc.offset_cuts(spark.createDataFrame(rows, "site STRING, method STRING, offset INT, status INT, body STRING"), page_size=2)
    assert [(r.last_offset, r.failed) for r in cuts.collect()] == [(2, False)]
    assert "ArrowEvalPython" in cuts._jdf.queryExecution().optimizedPlan().toString()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= rpc.BATCH_CALLS
