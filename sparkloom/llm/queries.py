"""The queries of the subpackage, and SQL for those that SQL can express."""

from . import ann, classifier, licenses, lm, packing, pieces, pii, rules, simhash, warc

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_classifier": classifier.op2_classifier,
    "op3_pieces": pieces.op3_pieces,
    "op4_pii": pii.op4_pii,
    "op5_lm": lm.op5_lm,
    "op6_warc": warc.op6_warc,
    "op7_neighbours": ann.op7_neighbours,
    "op8_licenses": licenses.op8_licenses,
    "op8_spans": licenses.op8_spans,
    "op9_packing": packing.op9_packing,
    "op10_rules": rules.op10_rules,
    "rule_ablations": rules.rule_ablations,
}
ORACLE_SQL = {"op6_warc": warc.OP6_SQL, "op8_licenses": licenses.OP8_SQL, "op10_rules": rules.OP10_SQL, "rule_ablations": rules.ABLATIONS_SQL}
