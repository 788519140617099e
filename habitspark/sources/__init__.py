"""Readers and writers for the tables the engine works on."""
