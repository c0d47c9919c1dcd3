"""Every filter of a registered query, with its reason: none makes a table smaller only to make a query cheap."""

import re
from pathlib import Path

import concord.plans

PART = {"part = 'train'": "a probe learns from one part", "part = 'test'": "and is tested on the other"}
REASONS = {
    "heldout_anti_join": {"o_orderdate < '1993-01-01'": "the rows that are held out"},
    "jsonl_by_prefix": {'F.col("o_orderstatus") == status': "a folder for each status, all of which are written"},
    "fixed_width_codes": {"length(p_name) >= 1": "a line needs a name to have a code"},
    "report_files": {"n_nationkey % 3 <> 0": "the rows that have a file; the others have texts"},
    "unit_runner": {"o_orderstatus = 'F'": "the units of a first run; the second has all"},
    "moved_parameters": {"c_acctbal > -900": "what the older table was built from"},
    "run_enumeration": {"o_totalprice > 470000": "the runs that are done; all others are the result"},
    "consensus_cases": {"encoder = 'full' OR case_id % 10 <> 3": "cases that one encoder lacks, to be dropped"},
    "table_states": {"s_acctbal > 9000": "so that some regions have no rows", 'F.col("n_regionkey") == r.r_regionkey': "a table for each region"},
    "bh_fdr_whole": {"p_raw IS NOT NULL": "rows without p, which the operator has passed through"},
    "class_centroid_distance": {"a < b": "each pair once"},
    "structural_reference": {"replicate >= 0": "the replicates"},
    "structural_reference_whole": {"replicate >= 0": "the replicates, beside the observed value"},
    "triplet_choice_whole": {"vec_id % 11 <> 0": "cases without labels, which a stratum counts", "encoder <> 'va' OR case_id % 10 <> 3": "absent vectors, which are counted"},
    "centroid_grade_order": {"label >= 1": "the graded", "label = 0": "the healthy"},
    "pool_build": {'F.col("source") == s': "a master for each site, all of which are read"},
    "ontology_link": {"a < b": "each pair once"},
    "source_precedence": {"s_nationkey % 2 = 0": "runs that were measured too"},
    "map_budget_sweep": PART,
    "_links": {"a <> b": "no pair of a nation with itself"},
    "paired_reports": {"doc_id % 11 <> 0": "cases that the other table lacks", "doc_id % 13 <> 0": "files that are not there"},
    "stale_tables": {'F.col("r_regionkey") == r.r_regionkey': "a table for each region"},
    "files_that_changed": {'F.col("o_orderstatus").rlike(kept)': "files that an older or a newer folder lacks, which is the result"},
    "consensus_build": {"case_id % 10 <> 0": "anchors are cases that every encoder has"},
    "linear_probe": PART,
    "finding_aurocs": PART,
    "multiclass_probe": PART,
    "refit_budget": PART,
    "transfer_matrix": PART,
    "stitch_retention": PART | {"encoder = 'va'": "the source", "encoder = 'vb'": "the target"},
    "cross_site": {"site = 0": "the home site", "site = 1": "the other"},
}


def test_every_filter_has_a_reason():
    found = {}
    for path in Path(concord.plans.__file__).parent.glob("*.py"):
        if path.stem in ("pipelines", "units", "catalogue"):  # compositions, not queries
            continue
        text = path.read_text()
        for m in re.finditer(r"\.(filter|where|limit|sample)\(", text):
            end, depth = m.end(), 1
            while depth:
                depth += (text[end] == "(") - (text[end] == ")")
                end += 1
            name = re.findall(r"\ndef (\w+)\(", text[: m.start()])[-1]
            found.setdefault(name, set()).add(text[m.end() : end - 1].strip('"'))
            assert m[1] == "filter", (name, m[1])
    assert found == {name: set(r) for name, r in REASONS.items()}
