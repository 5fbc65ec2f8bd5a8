"""Types, field references and predicates that operators share."""
