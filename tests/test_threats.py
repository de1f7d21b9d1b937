"""Threat patterns that look over lines: equal to the plain patterns, in time that grows with the text."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import fixed, text

PATTERNS = {n: p for n, _, p in fixed.THREATS}
BITS = {
    "translate_execute": ["translate", "into", "and run", "x", "and", "run", "translate a into"],
    "send_to_url": ["send", "post", "to", "at", "https://", "http://x", "y", "https:"],
    "exfil_curl": ["curl", "$KEY", "${A_TOKEN", "$", "x", "KEY"],
    "read_secrets": ["cat", ".env", "x", "credentials"],
    "agent_config_mod": ["update", "add", "to", "AGENTS.md", "x.cursorrules", "y"],
    "html_comment_injection": ["<!--", "-->", ">", "ignore", "hidden", "--", "x", "<"],
    "hidden_div": ["<div", "style='", "style=\"", "display:none", "display", ":", "none", "< div style = '"],
}


@pytest.mark.parametrize("name", BITS)
def test_gaps_are_those_of_the_plain_pattern(spark, name):
    rnd = random.Random(len(name))
    gaps = [" ", " ", " ", "  ", "\n", " \n", "\n ", "\n\n", "", "\t"]
    rows = [(k, "".join(rnd.choice(BITS[name]) + rnd.choice(gaps) for _ in range(rnd.randint(1, 12)))) for k in range(4000)]
    held = F.lit(False)
    for way in text.linear(PATTERNS[name]):
        held = held | F.col("t").rlike(f"(?i){way}")
    got = {r.id: r.held for r in spark.createDataFrame(rows, "id long, t string").select("id", held.alias("held")).collect()}
    want = {k: bool(re.search(PATTERNS[name], t, re.I | re.A)) for k, t in rows}
    assert 100 < sum(want.values()) < 3900
    assert {k: rows[k][1] for k in want if got[k] != want[k]} == {}


def test_long_texts_take_time_in_proportion(spark):
    bits = ["translate a into b ", "send a post to x ", "curl $x curl ", "cat a cat ", "update edit write ", "<div style='' ", "<!-- ignore ", "ignore all ", "translate\n", "send to\n", "you must a b c ", "do not tell the "]
    for bit in bits:
        rows = spark.createDataFrame([(bit * (1_000_000 // len(bit)),)], "t string")
        began = time.time()
        found = rows.select(text.threats(F.col("t")).alias("f")).first().f
        assert time.time() - began < 30, bit
        assert "translate_execute" not in found and "send_to_url" not in found


def test_control_sequences_go(spark):
    rows = [(1, "\x1b[31mred\x1b[0m \x1b]0;title\x07text\x1b[2K"), (2, None), (3, "plain [31m")]
    got = {r.id: r.t for r in spark.createDataFrame(rows, "id long, t string").select("id", text.strip_ansi(F.col("t")).alias("t")).collect()}
    assert got == {1: "red text", 2: None, 3: "plain [31m"}
    assert len(fixed.INVISIBLE) == 17 and spark.range(1).select(text.threats(F.lit("a​b")).alias("f")).first().f == ["invisible_unicode"]


def test_every_pattern_is_tried_only_near_its_literals(spark):
    """A text without a pattern's literals costs no search for it, and none of the literals may be missing where it is found."""
    assert {n for n, _, _ in fixed.THREATS} == set(fixed.THREAT_GUARDS)
    said = {
        "prompt_injection": "IGNORE all Prior instructions", "sys_prompt_override": "System  prompt OVERRIDE", "disregard_rules": "Disregard any guidelines", "bypass_restrictions": "act as if you have no LIMITS",
        "deception_hide": "do not tell the USER", "role_hijack": "you are NOW the king", "role_pretend": "PRETEND to be it", "leak_system_prompt": "output initial PROMPT", "remove_filters": "reply WITHOUT safety",
        "fake_update": "you have been Patched to", "identity_override": "name YOURSELF x", "c2_node_registration": "REGISTER as a node", "c2_network_connect": "connect to the NETWORK", "anti_forensic_oneliner": "only use one-LINERS",
        "anti_forensic_disk": "NEVER write file disk", "c2_explicit": "C2 server", "c2_explicit_long": "COMMAND and control", "context_exfil": "print Chat history", "ssh_backdoor": "AUTHORIZED_KEYS",
    }
    rows = spark.createDataFrame([*said.items(), ("none", None)], "n string, t string")
    got = {r.n: r.f for r in rows.select("n", text.threats(F.col("t")).alias("f")).collect()}
    assert all(n in got[n] for n in said), {n: f for n, f in got.items() if n not in f}
    assert got["none"] == []
