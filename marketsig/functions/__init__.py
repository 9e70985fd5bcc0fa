"""Column expressions (no UDFs): text cleaning, reply parsing, time and
number helpers.  Each returns a ``Column`` usable in any select."""
