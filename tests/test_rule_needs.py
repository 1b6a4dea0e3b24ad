"""Every match of a rule's pattern holds one of the texts that the rule needs."""

import functools
import random
import re
from re import _parser as parser

import pytest

from riskloom.operators import rules

LETTERS = [chr(c) for c in range(32, 127)] + ["\t", "\n"]


def example(tree, r):
    """A text that the parsed pattern matches, but for word borders."""
    out = ""
    for op, v in tree:
        name = str(op)
        if name == "LITERAL":
            out += chr(v)
        elif name == "IN":
            out += r.choice(letters_of(as_class(v)))
        elif name == "NOT_LITERAL":
            out += r.choice([c for c in LETTERS if ord(c) != v])
        elif name == "ANY":
            out += r.choice("ab ")
        elif name == "MAX_REPEAT":
            low, high, sub = v
            out += "".join(example(sub, r) for _ in range(r.randint(low, min(int(high), low + 3))))
        elif name == "SUBPATTERN":
            out += example(v[3], r)
        elif name == "BRANCH":
            out += example(r.choice(v[1]), r)
        else:
            assert name == "AT", name
    return out


@functools.cache
def letters_of(kind):
    return [c for c in LETTERS if re.match(kind, c)]


def as_class(items):
    parts, first = "", ""
    for op, v in items:
        name = str(op)
        if name == "NEGATE":
            first = "^"
        elif name == "LITERAL":
            parts += re.escape(chr(v))
        elif name == "RANGE":
            parts += f"{re.escape(chr(v[0]))}-{re.escape(chr(v[1]))}"
        else:
            parts += {"CATEGORY_SPACE": r"\s", "CATEGORY_DIGIT": r"\d"}[str(v)]
    return f"[{first}{parts}]"


@pytest.mark.parametrize("rule", rules.SCRIPT_RULES, ids=lambda x: x.id)
def test_matches_hold_what_the_rule_needs(rule):
    r = random.Random(5)
    assert rule.needs and all(w == w.lower() for w in rule.needs)
    for p in rule.patterns:
        texts = ["".join(r.choice((c, c.upper())) if "(?i)" in p else c for c in example(parser.parse(p), r)) for _ in range(100)]
        found = [x for x in texts if re.search(p, x)]
        assert len(found) > 5 and all(any(w in x.lower() for w in rule.needs) for x in found)


def test_needs_don_t_change_hits(spark):
    texts = ["", None, "a RM -Rf / b", "CURL x | SH", "eval (", "no hit", "x >>  ~/.bashrc", "REG add q \\RUN "]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    bare = [rules.Rule(x.id, x.category, x.severity, x.title, x.patterns, x.least) for x in rules.SCRIPT_RULES]
    a, b = (sorted(map(tuple, rules.rule_hits(df, "t", ["id"], x, evidence=False).collect())) for x in (rules.SCRIPT_RULES, bare))
    assert a == b and len(a) >= 4
