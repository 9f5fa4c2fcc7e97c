"""DataFrame-to-DataFrame operators on pings, stays, contacts and cases."""
