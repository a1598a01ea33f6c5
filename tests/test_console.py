"""The command line: layouts, variables, inputs, exit codes; streams on the driver and files through Spark."""

import io
import sys
import types

import pytest

from quern import console

BOOK = '{"title":"Öl\\n","pages":[{"no":7,"by":"ż🎲"},12],"tags":{},"lent":[]}'


def go(monkeypatch, args, text=""):
    out, err = io.BytesIO(), io.StringIO()
    monkeypatch.setattr(sys, "stdin", types.SimpleNamespace(buffer=io.BytesIO(text.encode())))
    monkeypatch.setattr(sys, "stdout", types.SimpleNamespace(buffer=out, isatty=lambda: False))
    monkeypatch.setattr(sys, "stderr", err)
    code = console.main(args)
    return code, out.getvalue().decode(), err.getvalue()


@pytest.mark.parametrize(
    ("args", "text", "expected"),
    [
        # layouts: two spaces unless told otherwise, the last option counts, empty containers stay on a line
        ([".pages[0], .lent"], BOOK, '{\n  "no": 7,\n  "by": "ż🎲"\n}\n[]\n'),
        (["-c", "--tab", ".pages"], BOOK, '[\n\t{\n\t\t"no": 7,\n\t\t"by": "ż🎲"\n\t},\n\t12\n]\n'),
        (["--tab", "-c", ".pages"], BOOK, '[{"no":7,"by":"ż🎲"},12]\n'),
        (["--indent", "3", ".pages[1:]"], BOOK, "[\n   12\n]\n"),
        (["-S", "-c", "."], BOOK, '{"lent":[],"pages":[{"by":"ż🎲","no":7},12],"tags":{},"title":"Öl\\n"}\n'),
        (["-S", "-c", "to_entries[0].key"], BOOK, '"title"\n'),  # keys are sorted when printed, not before
        # strings without quotes, nothing or NUL between outputs
        (["-r", ".title, .pages[1], .none"], BOOK, "Öl\n\n12\nnull\n"),
        (["-j", ".pages[] | numbers, .by?"], BOOK, "ż🎲12"),
        (["--raw-output0", "keys[]"], '{"q":1,"p":2}', "p\0q\0"),
        (["-a", ".pages[0].by"], BOOK, '"\\u017c\\ud83c\\udfb2"\n'),
        (["-c", ".[]"], '["\\u0008\\u000b","\\/"]', '"\\b\\u000b"\n"/"\n'),
        (["-C", "-c", "[null, \"t\"]"], "0", "\x1b[1;39m[\x1b[0m\x1b[0;90mnull\x1b[0m\x1b[1;39m,\x1b[0m\x1b[0;32m\"t\"\x1b[0m\x1b[1;39m]\x1b[0m\n"),
        (["-M", "-C", "-c", "{}"], "0", "{}\n"),
        # framing: values end where they end, whatever stands between them
        (["-c", "[.]"], "true\t[6,\n7]{}\n\n \"]\" null", '[true]\n[[6,7]]\n[{}]\n["]"]\n[null]\n'),
        (["-s", "-c", "map(length)"], '"ab"\n[1]\n{"x":0}', "[2,1,1]\n"),
        (["-s", "length"], "  \n", "0\n"),
        (["-n", "-c", "[inputs | . * 10]"], "4 5\n6", "[40,50,60]\n"),
        (["-n", "-c", "input, [inputs]"], "4 5 6", "4\n[5,6]\n"),
        (["-c", "[input_line_number, .]"], '"p"\n"q"\n', '[1,"p"]\n[2,"q"]\n'),
        (["-R", "-c", "[., length]"], "uno\n\ndue ", '["uno",3]\n["",0]\n["due ",4]\n'),
        (["-R", "-s", "ascii_upcase"], "uno\ndue", '"UNO\\nDUE"\n'),
        (["-c", "--stream", "."], '{"w":[{"k":null},[]]}', '[["w",0,"k"],null]\n[["w",0,"k"]]\n[["w",1],[]]\n[["w",1]]\n[["w"]]\n'),
        (["-n", "-c", "--stream", "[inputs | select(length == 2) | .[1]]"], '{"w":[3,{"v":4}]}', "[3,4]\n"),
        # variables; values may begin with a hyphen
        (["-n", "-c", "[$low, $ARGS.named.deep.x]", "--arg", "low", "-7", "--argjson", "deep", '{"x":-0.50}'], "", '["-7",-0.50]\n'),
        (["-n", "-r", "$ARGS.positional | join(\"+\")", "--args", "one", "two"], "", "one+two\n"),
        (["-n", "-c", "$ARGS.positional[1]", "--jsonargs", "0", '[{"y":[]}]'], "", '[{"y":[]}]\n'),
        (["-n", "$ENV | type"], "", '"object"\n'),
    ],
)
def test_output(monkeypatch, args, text, expected):
    assert go(monkeypatch, args, text)[:2] == (0, expected)


@pytest.mark.parametrize(
    ("args", "text", "code", "out", "said"),
    [
        (["-c", ".[0]"], "[8]\n{}\n[9]\n", 5, "8\n9\n", "(at <stdin>:2): Cannot index object"),  # later records go on
        (["--raw-output0", ".[]"], '["fine","not\\u0000so"]', 5, "fine\0", "NUL"),
        (["-c", "--stream", "."], '[{"k":2},', 5, '[[0,"k"],2]\n[[0,"k"]]\n', "EOF"),
        (["-n", "1 + nothing"], "", 3, "", "nothing/0 is not defined"),
        (["--indent", "-1", "."], "1", 2, "", "more than 7"),
        (["-n", "--argjson", "v", "[1,", "$v"], "", 2, "", "invalid JSON"),
        ([".", "/not/there.ndjson"], "", 2, "", "No such file"),
        (["-e", ".[]"], "[true, null]", 1, "true\nnull\n", ""),
        (["-e", "select(. > 5)"], "2", 4, "", ""),
        (["-c", "debug(\"seen\") | halt_error(9)"], '{"q":1} 2', 9, "", '["DEBUG:","seen"]\n{"q":1}\n'),
        (['"stop\\n" | halt_error'], "1 2", 5, "", "stop\n"),
    ],
)
def test_codes(monkeypatch, args, text, code, out, said):
    found = go(monkeypatch, args, text)
    assert found[:2] == (code, out)
    assert said in found[2]


def test_files(spark, monkeypatch, tmp_path):
    """Files keep the order given, their names and places; splittable ones as well."""
    for name, text in {"one.json": '{"w":"p"}\n{"w":"qq"}\n', "two.json": '{"w":\n"rrr"}', "none.json": "", "odd.json": '{"w":"s"}\n{"w":"t"}\n"u"', "count.txt": "# letters\n.w | length\n"}.items():
        (tmp_path / name).write_text(text)
    one, two, none, odd, program = (str(tmp_path / n) for n in ("one.json", "two.json", "none.json", "odd.json", "count.txt"))
    assert go(monkeypatch, ["-r", ".w", two, none, one])[:2] == (0, "rrr\np\nqq\n")
    assert go(monkeypatch, ["-r", "(input_filename | split(\"/\") | last) + \" \" + .w", one, two])[1] == "one.json p\none.json qq\ntwo.json rrr\n"
    assert go(monkeypatch, ["-s", "-r", "map(.w) | add", two, one])[1] == "rrrpqq\n"
    assert go(monkeypatch, ["-n", "-c", "[inputs.w | length]", one, two])[1] == "[1,2,3]\n"
    assert go(monkeypatch, ["-R", "-s", "split(\"\\n\") | length", one, none, two])[1] == "4\n"
    assert go(monkeypatch, ["-f", program, two])[1] == "3\n"
    assert go(monkeypatch, ["-n", "-c", "--slurpfile", "s", two, "--rawfile", "r", program, "[$s[0].w, ($r | test(\"letters\"))]"])[1] == '["rrr",true]\n'
    code, out, said = go(monkeypatch, ["-r", ".w", odd, "/not/there"])
    assert (code, out) == (5, "s\nt\n") and f"{odd}:2): Cannot index string" in said and "No such file" in said
    many = tmp_path / "many.txt"
    many.write_text("".join(f'["{"w" * (row % 50)}", {row}]\n' for row in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        assert go(monkeypatch, ["--lines", ".[1] - (.[0] | length)", str(many)])[1] == "".join(f"{row - row % 50}\n" for row in range(20000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
