"""Plans that need more than one job: intermediate tables in the shared folder."""
