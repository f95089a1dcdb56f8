"""The registered queries and their SQL."""

from verdigraph.queries import chaining, logic, policy, storing, texts

QUERIES: dict = {**logic.Q, **policy.Q, **chaining.Q, **texts.Q, **storing.Q}
ORACLES: dict = {**logic.SQL, **policy.SQL, **chaining.SQL, **texts.SQL, **storing.SQL}
