"""Schemas as plans: parsing, flat layout and evolution mappings, all on the driver."""
