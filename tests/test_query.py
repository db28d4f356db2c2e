import pytest

from lexspark.plans.query import Settings, extra_types, parse_query


@pytest.mark.parametrize(
    "raw,text,lists",
    [
        ('red "blue sky" -green', "red blue sky", {"phrases": ["blue sky"], "excluded_terms": ["green"]}),
        ('-"Not This" word', "word", {"excluded_phrases": ["Not This"]}),
        ("ext:.MD .txt EXT:pdf", "", {"ext": ["md", "txt", "pdf"]}),
        ("Path:Notes/ -path:OLD path:", "", {"paths": ["notes/"], "excluded_paths": ["old"]}),
        ("a - b", "a - b", {}),
        ('path:"a b" c', "c a b", {"phrases": ["a b"]}),
        ('x-"y" ""', "x", {"excluded_phrases": ["y"]}),
        ("-ext:md -.md", "", {"excluded_terms": ["ext:md", ".md"]}),
        ("", "", {}),
        ('open "quote', 'open "quote', {}),
    ],
)
def test_parse(raw, text, lists):
    got = parse_query(raw)
    assert got.text == text
    for name in ("phrases", "excluded_phrases", "excluded_terms", "ext", "paths", "excluded_paths"):
        assert getattr(got, name) == lists.get(name, [])


def test_settings():
    assert Settings().options_hash() == "1|nocamel"
    assert Settings(split_camel_case=True).options_hash() == "1|camel"
    assert extra_types(" .TXT, org  ") == ("txt", "org")
