"""All registered queries; importing the modules registers theirs."""

from versehall.plans import arrivals, chains, dialogues, entities, files, ordered, relational, rules, sequences, spellings, statistics, texts  # noqa: F401
from versehall.plans.registry import QUERIES, SQL  # noqa: F401
