"""The operators bound to the shared test tables, with equivalent SQL."""
