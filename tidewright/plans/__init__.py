"""Registered queries, each a function of (session, data folder), with the same result as SQL where SQL can say it."""
