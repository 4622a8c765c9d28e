"""The fold with evidence against a plain reading of its rules."""

import itertools

from tessera.operators import merging

SIGNALS = "domain string, sid string, grp string, value string, evidence string, url string, note string, method string"
OFFERS = "domain string, sid string, layer int, value string, match string, evidence string, url string, note string, method string"


def plain(state, offer, sid, grp):
    value, evidence, *_ = state
    new, match, ev, url, note, method = offer
    strict = (grp, new) in {("exclusion", "yes"), ("must", "no")}
    if new in ("yes", "no") and not (match == "strong" or match == "medium" and not strict):
        if (grp, new) != ("exclusion", "yes"):
            return state
        said, note = "check", "possible match only, to confirm: " + note
    else:
        said = new
    over = sid == "E5" and new == "yes" and value == "no" and evidence.startswith("for-profit legal entity")
    if value in ("yes", "no") and said in ("yes", "no") and said != value and match == "strong" and not over:
        return ("check", f"website: {evidence} | {method}: {ev}", url, f"website said {value}, {method} said {new} ({note})", method)
    if value not in ("check", "unknown") and not over or value == said == "check":
        return state
    return (said, ev, url, f"{method}, {match} match: {note}", method)


def test_every_pair_of_a_state_and_two_offers(spark):
    cases, want = [], {}
    values, offers = ("yes", "no", "check", "unknown"), list(itertools.product(("yes", "no", "check"), ("strong", "medium", "weak")))
    signals = []
    for k, ((sid, grp), value, (n1, m1), (n2, m2)) in enumerate(itertools.product((("F1", "fit"), ("M2", "must"), ("E1", "exclusion"), ("E5", "exclusion")), values, offers, offers)):
        state = (value, "for-profit legal entity: Inc" if k % 2 else "page", "u0", "", "code")
        signals.append((str(k), sid, grp, *state))
        for layer, new, match in ((1, n1, m1), (2, n2, m2)):
            offer = (new, match, f"ev{layer}", f"u{layer}", f"n{layer}", "directory" if layer == 1 else "provider")
            cases.append((str(k), sid, layer, *offer))
            state = plain(state, offer, sid, grp)
        want[str(k), sid] = state
    out = merging.settle_evidence(spark.createDataFrame(signals, SIGNALS), spark.createDataFrame(cases, OFFERS))
    assert {(r.domain, r.sid): (r.value, r.evidence, r.url, r.note, r.method) for r in out.collect()} == want


def test_contradicted_place_opens_the_other_fact(spark):
    signals = [("a", "M1", "must", "no", "about page", "", "", "code"), ("a", "E4", "exclusion", "yes", "about page", "u", "", "code"), ("b", "M1", "must", "no", None, None, None, None)]
    offers = [("a", "M1", 1, "yes", "strong", "Austin", "r", "n", "directory"), ("a", "E4", 2, "no", "medium", "hq", "p", "n", "provider"), ("b", "F9", 1, "yes", "strong", "x", "x", "x", "x")]
    got = {(r.domain, r.sid): (r.value, r.evidence, r.note) for r in merging.settle_evidence(spark.createDataFrame(signals, SIGNALS), spark.createDataFrame(offers, OFFERS)).collect()}
    assert got["a", "M1"] == ("check", "website: about page | directory: Austin", "website said no, directory said yes (n)")
    assert got["a", "E4"] == ("no", "hq", "provider, medium match: n") and got["b", "M1"] == ("no", "", "") and len(got) == 3
    first = merging.settle_evidence(spark.createDataFrame(signals, SIGNALS), spark.createDataFrame(offers[:1], OFFERS)).where("sid = 'E4'").first()
    assert (first.value, first.note, first.method) == ("check", "directory shows a US location: Austin", "directory")
