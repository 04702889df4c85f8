import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import tokens

pytest.importorskip("public_tokenizers")
PATH = tokens.default_file()
CASES = [
    "12\n00:00:01,250 --> 00:00:03,999\nIt's a dog, isn't it?  No...\n\n13\r\n00:00:04,000 --> 01:02:03,100\r\n", "00:45.615 --> 00:48.654\n", "99:00:00,0001 --> 00:00", "a b c\x1cd\u0085e",
    "♪ pluie ♪ Ã©té � ½ ²x ΘΣ", "<|endoftext|>", "x" * 5000, " " * 3000 + "a", "你好", "", "::12:34:56,789 -->00", "01:02,333", "1:02:03.444 ", "ıſ'S",
]


@pytest.mark.parametrize("text", CASES)
def test_equals_the_tokenizer(text):
    assert tokens.count(text, PATH) == len(tokens.encoding(PATH).encode_ordinary(text))


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.text(alphabet="0123456789:,.-> \n\r'stremvlé♪ AB")))
def test_equals_the_tokenizer_on_any_text(text):
    assert tokens.count(text, PATH) == len(tokens.encoding(PATH).encode_ordinary(text))


def test_table(spark):
    df = spark.createDataFrame([(1, "a", "two words", 3), (2, None, None, 3), (3, "b", "", 3)], "doc_id long, source string, text string, n_tokens int")
    assert sorted((tuple(r) for r in tokens.token_sizes(df).collect()), key=repr) == [(1, "a", 2), (2, None, 0), (3, "b", 0)]
