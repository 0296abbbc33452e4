"""Training-data operators: each works on whole tables and keeps every row unless its decision says otherwise."""
