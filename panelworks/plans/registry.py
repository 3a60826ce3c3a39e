"""All registered queries of the panel engine and their SQL oracles."""

from panelworks.plans import actions, archives, books, dated, evaluation, evidence, heads, history, identity, intake, notices, panel, publication, quality, repairs, replays, reports, shaping, trading

FLAGSHIP = panel.FLAGSHIP
QUERIES, ORACLES = {}, {}
for _plan in (panel, shaping, evaluation, heads, history, quality, actions, books, dated, reports, intake, publication, repairs, identity, archives, evidence, notices, replays, trading):
    QUERIES |= _plan.QUERIES
    ORACLES |= _plan.ORACLES
