from logloom.operators.filters import filter_logs
from logloom.operators.parse import parse_logs
from logloom.schema import LOG_COLUMNS

TS = "2024-01-15T12:00:00.000000000Z"


def parse(lines, raws, **options):
    return {r["seq"]: r for r in parse_logs(lines(raws), **options).collect()}


def test_plain_json_and_bare_lines(lines):
    rows = parse(
        lines,
        [
            f"{TS} Hello world",
            f'{TS} {{"level":"info","msg":"server started","port":8080}}',
            "no timestamp here",
            f"{TS} {{not valid json}}",
            "",
            "   \t　",
            '{"severity":"WARN","message":"m","service":"api"}',
        ],
    )
    assert sorted(rows) == [0, 1, 2, 3, 6]
    assert (rows[0]["timestamp"], rows[0]["message"], rows[0]["is_json"]) == (TS, "Hello world", False)
    assert rows[1]["is_json"] and rows[1]["message"] == "server started" and rows[1]["level"] == "info"
    assert rows[1]["structured"] == {"level": "info", "msg": "server started", "port": "8080"} == rows[1]["extra"]
    assert (rows[2]["timestamp"], rows[2]["ts"], rows[2]["message"]) == (None, None, "no timestamp here")
    assert rows[3]["message"] == "{not valid json}" and not rows[3]["is_json"] and rows[3]["structured"] == {}
    assert (rows[6]["level"], rows[6]["service"], rows[6]["message"]) == ("WARN", "api", "m")
    assert rows[0]["ts"].isoformat().startswith("2024-01-15T12:00:00")


def test_json_corner_cases(lines):
    rows = parse(
        lines,
        [
            '{"a":1} {"b":2}',
            '{"a":1},{"b":2}',
            "{'a': 1}",
            '  {"msg":"padded"}\t',
            '{"level":null,"severity":"x","msg":"first","msg":"last"}',
            '{"nested":{"k":[1,2]},"t":true,"f":1.50}',
            "[1,2]",
            "{}",
        ],
    )
    assert not any(rows[i]["is_json"] for i in (0, 1, 2, 6))
    assert rows[3]["message"] == "padded"
    assert rows[4]["level"] is None and rows[4]["message"] == "last"
    assert rows[5]["structured"] == {"nested": '{"k":[1,2]}', "t": "true", "f": "1.5"}
    assert rows[5]["message"].startswith('{"nested"')
    assert rows[7]["is_json"] and rows[7]["message"] == "{}"


def test_timestamp_prefix_rules(lines):
    rows = parse(
        lines,
        ["2024-01-15T12:00:00Z   spaced body ", "2024-01-15T12:00:00 no zone", "2024-01-15T12:00:00Z", "2024-99-15T12:00:00Z x"],
    )
    assert rows[0]["message"] == "spaced body "
    assert rows[1]["timestamp"] is None and rows[2]["timestamp"] is None
    assert rows[2]["message"] == "2024-01-15T12:00:00Z"
    assert rows[3]["timestamp"] == "2024-99-15T12:00:00Z" and rows[3]["ts"] is None


def test_text_level_is_opt_in(lines):
    raws = ["2024-01-01T00:00:01Z ERROR boom", '{"msg":"an error"}']
    assert parse(lines, raws)[0]["level"] is None
    rows = parse(lines, raws, text_level=True)
    assert rows[0]["level"] == "ERROR" and rows[1]["level"] is None


def test_filters_do_not_repeat_the_parse(lines):
    logs = parse_logs(lines(["x"]))
    assert logs.columns == LOG_COLUMNS
    found = filter_logs(logs, "a", level="error").where("service = 's'")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
