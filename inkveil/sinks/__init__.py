"""Files written from redacted tables, each with a reader that verification uses."""
