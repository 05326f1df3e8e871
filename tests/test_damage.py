from tallyfold.sources import logs

LINES = [
    "{", "[1]", '{"uuid":"x"}', '{"type":"user"}', '{"type":"system","subtype":"compact_boundary"}', '{"type":"system"}', "  ",
    '{"type":"assistant","message":{"usage":{"input_tokens":1}}}', '{"type":"assistant","message":{"model":"m","usage":{"input_tokens":-1}}}',
    '{"type":"assistant","message":{"model":"m","usage":{"input_tokens":1}}}', '{"type":"assistant"}', '{"type":"wibble"}',
]


def routed(spark):
    rows = [(1, k, v, "a/1.jsonl") for k, v in enumerate(LINES, 1)]
    return logs.routed(spark.createDataFrame(rows, "session_id long, line long, value string, path string"))


def test_damage_of_each_kind(spark):
    got = {(r.line, r.kind, r.sample) for r in logs.damage(routed(spark), "session_id").collect()}
    assert got == {
        (1, "unparseable_json", "1.jsonl:1"), (2, "not_an_object", "1.jsonl:2"), (3, "missing_type", "1.jsonl:3"),
        (5, "malformed_record", "1.jsonl:5: the boundary has no usable metadata"),
        (8, "malformed_record", "1.jsonl:8: the record has usage but no model, so it cannot be priced"),
        (9, "malformed_record", "1.jsonl:9: a token count is not a non-negative whole number"),
    }


def test_lines_are_not_parsed_again_for_each_sum(spark):
    """Before, the plan of the diagnostics parsed the lines once for each kind and sum, and in each filter again."""
    found = logs.diagnostics(logs.damage(routed(spark), "session_id"), "session_id")
    assert "parseJson" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.kind, r["count"], r.sample_lines) for r in found.orderBy("kind").collect()] == [
        ("malformed_record", 3, [5, 8, 9]), ("missing_type", 1, [3]), ("not_an_object", 1, [2]), ("unparseable_json", 1, [1]),
    ]
