import urllib.parse

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kgspark import Template
from kgspark.terms import enc


def test_template_parts_and_inverse():
    t = Template("http://x/line/{a}/{b}")
    assert t.columns == ("a", "b") and t.injective
    assert t.invert("http://x/line/7/z%20z", ("long", "string")) == (7, "z z")
    assert t.invert("http://x/line/07/z", ("long", "string")) is None  # not the text the key builds
    assert t.invert("http://x/line/7/a b", ("long", "string")) is None
    assert t.invert("http://x/line/7", ("long", "string")) is None


def test_templates_that_share_no_iri():
    a, b = Template("http://x/customer/{k}"), Template("http://x/order/{k}")
    assert not a.may_unify(b) and a.may_unify(Template("http://x/customer/{other}"))
    assert not a.may_unify(Template("http://x/customer/{k}/{l}"))
    assert Template("http://x/{a}").may_unify(Template("http://x/c{b}"))


def test_adjacent_slots_are_not_a_key():
    assert not Template("http://x/{a}{b}").injective
    assert not Template("http://x/{a}-{b}").injective  # '-' may stand in a value
    assert Template("http://x/{a};{b}").injective


def test_escaped_braces():
    assert Template(r"http://x/\{{a\}b}").columns == ("a}b",)


def test_encoding_matches_the_rfc(spark):
    texts = ["a b", "*~-._", "ünï/€", "𝒳+%", "", "x" * 500 + "!'()", "\n\t"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", enc(F.col("t")).alias("e")).collect()
    assert all(r.e == urllib.parse.quote(r.t, safe="") for r in got)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), min_size=1), st.integers(-10**17, 10**17))
def test_inverse_of_any_key(text, number):
    t = Template("http://x/{a}/{b}")
    iri = f"http://x/{number}/{urllib.parse.quote(text, safe='')}"
    assert t.invert(iri, ("long", "string")) == (number, text)


@pytest.mark.parametrize("iri,keys", [("http://x/7/a%20b", (7, "a b")), ("http://x/07/a", (None, None)),
                                      ("http://x/7/a+b", (None, None)), ("http://y/7/a", (None, None))])
def test_keys_from_text(spark, iri, keys):
    t = Template("http://x/{a}/{b}")
    cols = t.parse(F.col("iri"), ("long", "string"))
    r = spark.createDataFrame([(iri,)], "iri string").select(cols[0].alias("a"), cols[1].alias("b")).first()
    assert (r.a, r.b) == keys
