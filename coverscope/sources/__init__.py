"""Readers and writers of files, and operators on tables of sheet cells."""
